"""The corpus pipeline's stages against brute force, and on odd tables."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm.quality_rules import Rules
from tests.llm.test_mixing import brute as mixed_by_hand
from tests.llm.test_near_dedup import kept_by_brute_force

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"word{i}" for i in range(900)]
LINE = "This line stands in many of the documents"


def document(rng: random.Random, n: int) -> str:
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 14))) for _ in range(n))


def table(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    texts = [document(rng, 6) for _ in range(60)]
    texts += [t + "\n" + LINE for t in texts[:14]]  # near copies that share a line
    texts += [texts[20]] * 5 + ["again and again " * 40, "too short", "", None]
    changed = texts[30].split(" ")
    for i in range(0, len(changed), 25):
        changed[i] = "other"
    texts.append(" ".join(changed))
    return [(i, t, ("en", "de", None)[i % 3], f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]


def fails(text: str | None) -> bool:
    """The quality rules over plain Python lists."""
    rules, words = Rules(), (text or "").split()
    if len(words) < rules.min_words:
        return True
    chars = sum(map(len, words))

    def windows(n: int) -> tuple[set[int], set[int]]:
        places: dict[tuple, list[int]] = {}
        for i in range(len(words) - n + 1):
            places.setdefault(tuple(words[i : i + n]), []).append(i)
        every = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + n)}
        later = {j for at in places.values() for i in at[1:] for j in range(i, i + n)}
        return every, later

    if 100 * len(windows(rules.repeat_window)[0]) > rules.repeat_words_pct * len(words):
        return True
    if any(100 * sum(len(words[j]) for j in windows(n)[1]) > pct * chars for n, pct in rules.ngram_chars_pct.items()):
        return True
    seen: set[str] = set()
    again = 0
    for line in (text or "").split("\n"):
        if line.split():
            again += sum(map(len, line.split())) if line in seen else 0
            seen.add(line)
    return 100 * again > rules.line_chars_pct * chars


def ids(df) -> list:
    return sorted((r.doc_id for r in df.collect()), key=lambda i: (i is None, i or 0))


def test_each_stage_equals_brute_force(spark):
    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = STAGES["quality_rules"](spark, docs, "")
    good = [r for r in rows if not fails(r[1])]
    assert kept.columns == docs.columns and ids(kept) == [r[0] for r in good] and len(good) < len(rows)

    lines = STAGES["line_dedup"](spark, spark.createDataFrame(good, SCHEMA), "").collect()
    holders = {}
    for r in good:
        for key in {x.strip().lower() for x in r[1].split("\n")} - {""}:
            holders.setdefault(key, set()).add(r[0])
    often = {k for k, v in holders.items() if len(v) >= 10}
    assert often == {LINE.lower()}
    strip = lambda t: "\n".join(x for x in t.split("\n") if x.strip().lower() not in often)
    before = {r[0]: r for r in good}
    assert len(lines) == len(good) and all(r.n_chars == len(r.text) for r in lines)
    assert all(strip(r.text) == strip(before[r.doc_id][1]) for r in lines)
    assert sum(LINE in r.text for r in lines) == 1  # one text keeps the line

    deduped = STAGES["near_dedup"](spark, spark.createDataFrame([tuple(r) for r in lines], SCHEMA), "")
    want = kept_by_brute_force([(r.doc_id, r.text.lower()) for r in sorted(lines)], 5, 0.8)
    assert ids(deduped) == want and len(want) < len(lines)

    left = [tuple(r) for r in deduped.collect()]
    mixed = STAGES["mixing"](spark, spark.createDataFrame(left, SCHEMA), "")
    leaves = [(r[0], r[1], f"d{r[3][-1]}", r[2], r[3]) for r in left]
    chosen = mixed_by_hand(leaves, corpus_pipeline.MIX_WEIGHTS, corpus_pipeline.MIX_SHARE, 1, 1)
    assert ids(mixed) == sorted(i for i, _, _ in chosen)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    packed = STAGES["packing"](spark, mixed, "").collect()
    whole = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0] for r in mixed.collect()}
    assert {r.doc_id for r in packed} == set(whole)
    for r in packed:
        part = whole[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    filled: dict[int, list] = {}
    for r in packed:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in packed) == sum(map(len, whole.values()))
    for pieces in filled.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048


ODD = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "src1", 0), (None, "some words " * 30, None, "src1", 330), (None, "some words " * 30, None, "src1", 330), (3, "a b c " * 60_000, "de", "src22", None), (4, "\n\n\t \n", "en", "", 5)]


@pytest.mark.parametrize("name", STAGES)
@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables_pass_every_stage(spark, name, empty):
    clashing = ["c0", "k0", "t", "id", "digest", "row", "node", "tokens", "epoch", "places", "text_id", "copies", "x", "share"]
    df = spark.createDataFrame([] if empty else ODD, SCHEMA).select("*", *(F.lit("own").alias(c) for c in clashing))
    out = STAGES[name](spark, df, "")
    rows = out.collect()
    if name != "packing":
        assert out.columns == df.columns and all(r[c] == "own" for r in rows for c in clashing)
    assert (not rows) if empty else True
    if name == "near_dedup" and not empty:
        assert sorted((r.doc_id for r in rows), key=repr) == sorted([1, 3, None], key=repr)


@pytest.mark.parametrize("name", list(STAGES))
def test_batches_of_a_stage_are_small(spark, name):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    STAGES[name](spark, spark.createDataFrame(table()[:20], SCHEMA), "").count()
    long = spark.range(0, 80, 1, 1).select(F.repeat(F.lit("word "), 50_000).alias("text"))  # 20 MB in one task
    sizes = long.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) > 1 and max(r.n for r in sizes) < 5 << 20
