from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import packing
from pulsegrid.llm.packing import CapacityTree, WordTokenizer, best_fit_decreasing, pack
from pulsegrid.llm.queries import tokenizer_path

WORDS = WordTokenizer(tokenizer_path())
ODD = ["ﬁ", "é", "é", "İstanbul", "ß", "中文字", "a b", "x y", "<|endoftext|>", "<|startoftext|>x", "don't", "we'll", "co-op", "3.14", "​", "😀!", "Ω", "naïve", "\x85", "\x1c", "a\u0000b", "ǅ", "I'M", "''s", "_a_", "</w>", "ŉ", "ſ", "K"]


def ids(text: bytes) -> list[int]:
    return np.frombuffer(text, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=8), st.text("abcXYZ'0.é_-", max_size=10)), max_size=12), st.sampled_from([" ", "\n", "\t\t", " \r\n", "\x0b", "\x0c"]))
def test_words_one_by_one_give_the_ids_of_the_whole_text(parts, space):
    text = space.join(parts)
    assert ids(WORDS.encode(text.encode(errors="replace"))) == WORDS.whole.encode(text.encode(errors="replace").decode(), add_special_tokens=False).ids


def test_tree_takes_the_tightest_capacity():
    rng = random.Random(4)
    tree, held = CapacityTree(64), defaultdict(list)
    for k in range(2000):
        if rng.random() < 0.5:
            c = rng.randint(0, 64)
            tree.put(c, k)
            held[c].append(k)
        else:
            n = rng.randint(0, 64)
            fits = [c for c in held if c >= n and held[c]]
            assert tree.tightest(n) == (min(fits) if fits else None)
            if fits:
                assert tree.take(min(fits)) == held[min(fits)].pop()


def test_best_fit_fills_well_and_without_gaps():
    lengths = np.sort(np.random.default_rng(1).integers(1, 2049, 3000))[::-1]
    sequence, offset = best_fit_decreasing(lengths, 2048)
    ends = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True):
        ends[s].append((o, n))
    for parts in ends.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(ends) <= -(-lengths.sum() // 2048) * 1.03


ROWS = [(1, "Hello world"), (2, None), (3, ""), (4, "token " * 5000), (4, "token " * 5000), (5, "x"), (None, "no id"), (6, "a b ünï <|endoftext|>")]


def test_pieces_hold_the_documents_and_lie_gapless(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as piece", "'z' as id")
    got = pack(df, tokenizer_path(), most=2048).collect()
    assert set(got[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    want = []
    for i, t in ROWS:
        doc = np.array([*WORDS.whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 2048, k, len(doc[k : k + 2048]), zlib.crc32(doc[k : k + 2048].tobytes())) for k in range(0, len(doc), 2048)]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) == -(-sum(w[3] for w in want) // 2048)


def test_several_groups_and_an_empty_table(spark):
    rows = [(i, i % 3, 0, 1 + i * 37 % 2048, i) for i in range(5000)]
    got = packing.assign(spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long"), 2048, groups=5).collect()
    assert len(got) == 5000
    total = defaultdict(int)
    for r in got:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 2048 and len(total) <= 1.03 * sum(total.values()) / 2048 + 5
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_another_tokenizer_takes_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    other, own = WordTokenizer(path), Tokenizer.from_file(path)
    assert WORDS.by_word and not other.by_word
    for text in ("Some words,  and  blanks\n\tÄ 12 <|endoftext|>", "", " "):
        assert other.encode(text.encode()) == b"".join(i.to_bytes(4, "little") for i in own.encode(text, add_special_tokens=False).ids)


def test_clashing_names_and_a_row_that_repeats_many_times(spark):
    rows = [(None, "the same row", "x", 1)] * 3000 + [(1, "another", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int").repartition(3)
    cut_up = packing.cut(packing.pieces(docs, ["doc_id"], lambda: WORDS.encode, 2048).withColumnRenamed("doc_id", "id"), "pieces")
    packed = packing.assign(cut_up, 2048, groups=8).collect()
    assert len(packed) == 3001
    assert len({r.sequence_id >> 32 for r in packed}) == 8
    assert len(pack(docs, tokenizer_path()).collect()) == 3001
