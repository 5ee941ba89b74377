from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import bpe_dp
from pulsegrid.llm.queries import QUERIES, tokenizer_path
from tests.conftest import DATA

PATH = tokenizer_path()
OWN = bpe_dp.tokenizer(PATH)
ODD = ["ﬁ", "é", "é", "İstanbul", "ß", "中文字", "a b", "x y", "<|endoftext|>", "<|startoftext|>x<|endoftext|>", "<|END|>", "don't", "we'll", "3.14", "​", "😀!", "Ω", "naïve", "\x85", "\x1c", "a\u0000b", "ǅ", "I'M", "''s", "_a_", "</w>", "ŉ", "ſ", "K"]


def ids(text: str) -> list[int]:
    return bpe_dp.id_lists([OWN.encode(text.encode())])[0].as_py()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(st.characters(codec="utf-8"), max_size=8), st.text("abcthe'0.é_-", max_size=14)), max_size=12), st.sampled_from([" ", "\n", "\t\t", "\x0b", ""]))
def test_same_ids_and_texts_as_the_library(parts, space):
    text = space.join(parts)
    found, expected = ids(text), OWN.whole.encode(text, add_special_tokens=False).ids
    assert found == expected
    said = OWN.whole.decode(expected, skip_special_tokens=False)
    assert OWN.decode(found) == said


def test_long_words_of_few_letters():
    rng = random.Random(2)
    for letters in ("a", "ab", "ano", "thein", "!?-", "aé"):
        word = "".join(rng.choice(letters) for _ in range(3000))
        assert ids(word) == OWN.whole.encode(word, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_random_merges_against_plain_merging(seed):
    """Vocabularies in which tokens meet themselves and some encode otherwise, against merging pair by pair."""
    rng = random.Random(seed)
    names, merges = list("abc"), []
    for _ in range(25):
        a, b = rng.choice(names), rng.choice(names)
        if a + b not in names:
            merges.append((a, b))
            names.append(a + b)
    one = bpe_dp.PrefixEncoder({t: k for k, t in enumerate(names)}, merges, "")
    for _ in range(20):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 25)))
        parts = list(word)
        while True:
            ranks = [merges.index(p) if (p := (x, y)) in merges else len(merges) for x, y in zip(parts, parts[1:])]
            if not ranks or min(ranks) == len(merges):
                break
            k = ranks.index(min(ranks))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert [names[k] for k in one.encode(word)] == parts


def test_vocabularies_of_other_kinds_are_refused():
    with pytest.raises(ValueError, match="one merge"):
        bpe_dp.PrefixEncoder({"a": 0, "b": 1, "ab": 2}, [("a", "b"), ("a", "b")], "")


def test_query_gives_the_library_s_digests(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    found = {r.doc_id: r for r in QUERIES["op11_bpe"](spark, f"{DATA}/sf0.001").collect()}
    assert len(found) == len(docs)
    for d in docs:
        expected = OWN.whole.encode(d.text or "", add_special_tokens=False).ids
        r = found[d.doc_id]
        assert r.n_tokens == len(expected)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(OWN.whole.decode(expected, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_empty_and_long_texts_repeats_and_clashing_names(spark):
    long = "wordlike " * 200_000 + "x" * 300_000
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (None, "hello there", None, "b"), (None, "hello there", None, "b"), (3, long, "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    encoded = bpe_dp.encode(docs, PATH, ["doc_id"])
    found = sorted(((r.doc_id or 0), r.ids) for r in encoded.collect())
    assert [x for x in found if x[0] in (1, 2)] == [(1, []), (2, [])]
    assert [x[1] for x in found if x[0] == 0] == [OWN.whole.encode("hello there", add_special_tokens=False).ids] * 2
    assert found[-1][1] == OWN.whole.encode(long, add_special_tokens=False).ids
    assert {r.doc_id: r.decoded for r in bpe_dp.decode(encoded, PATH, ["doc_id"]).collect()}[1] == ""
    assert bpe_dp.decode(bpe_dp.encode(docs.limit(0), PATH, ["doc_id"]), PATH, ["doc_id"]).count() == 0
