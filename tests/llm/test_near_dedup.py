"""The near-duplicate stage against brute force over all pairs."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import near_dedup as nd
from pulsegrid.llm.backoff_lm import Encoder


def jaccard(a: str, b: str, n: int) -> float:
    of = lambda t: {" ".join(t.lower().split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))}
    x, y = of(a), of(b)
    return len(x & y) / len(x | y)


def test_one_of_each_group_stays(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(500)]
    rows, groups = [], []
    for k in range(20):
        base = [rng.choice(vocabulary) for _ in range(300)]
        copies = []
        for c in range(3):
            t = list(base)
            for _ in range(2 * (c > 0)):
                t[rng.randrange(300)] = "changed"
            copies.append((10 * k + c, " ".join(t)))
        rows += copies
        groups.append(copies)
    rows += [(1000, None), (1001, ""), (1000, None), (None, "lone text of a few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a", F.lit("clash")).withColumn("fp", F.lit(1))
    kept = nd.one_of_each(df, shingle=5, least=0.8)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert all(jaccard(g[0][1], x[1], 5) >= 0.8 for g in groups for x in g)
    assert ids == sorted([10 * k for k in range(20)] + [1000, None], key=repr)


def test_texts_of_one_fingerprint_but_little_in_common_both_stay(spark):
    one, two = "alpha beta gamma delta epsilon zeta", "eta theta iota kappa lambda mu"
    kept = nd.one_of_each(spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_pairs_beyond_the_radius_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (4, 2540, 2789, 8154)").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(jaccard(texts[a], texts[b], 5) >= 0.8 for a, b in ((4, 2540), (2789, 8154)))
    for radius in (1, 5):
        assert sorted(r.doc_id for r in nd.one_of_each(docs, radius=radius).collect()) == [4, 2789]


def kept_by_brute_force(rows: list[tuple[int, str]], shingle: int, least: float) -> list[int]:
    grams = [{tuple(t.split()[i : i + shingle]) for i in range(max(1, len(t.split()) - shingle + 1))} for _, t in rows]
    low = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if low[i] != low[j] and len(grams[i] & grams[j]) >= least * len(grams[i] | grams[j]):
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    return sorted({min(rows[j][0] for j in range(len(rows)) if low[j] == k) for k in set(low)})


def test_texts_that_share_long_boilerplate_meet_their_partners(spark):
    rng = random.Random(4)
    vocabulary = [f"b{i}" for i in range(400)]
    licence = [rng.choice(vocabulary) for _ in range(600)]
    rows = []
    for k in range(60):  # unlike texts, with a near copy each, that differ in few words of many
        own = [rng.choice(vocabulary) for _ in range(170)]
        copy = list(own)
        for _ in range(rng.randint(1, 12)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows += [(2 * k, " ".join(licence + own)), (2 * k + 1, " ".join(licence + copy))]
    chain = [rng.choice(vocabulary) for _ in range(120)]
    for k in range(12):  # neighbours are alike, the ends are not
        chain = chain[4:] + [rng.choice(vocabulary) for _ in range(4)]
        rows.append((1000 + k, " ".join(chain)))
    want = kept_by_brute_force(rows, 5, 0.8)
    assert len(want) == 61
    got = nd.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == want


def test_empty_table_clashing_names_and_hot_copies(spark):
    schema = "doc_id long, text string"
    assert nd.one_of_each(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"l{k * k % 9973}" for k in range(30_000))
    rows = [(i, "one and the same short text of some words") for i in range(1, 200)] + [(i, "") for i in range(200, 230)] + [(300, None), (301, long), (302, long + " more"), (303, "x"), (304, "X"), (305, "x y")]
    rows += [(1, rows[0][1])] * 50 + [(None, "unlike all"), (None, "unlike all")]
    df = spark.createDataFrame(rows, schema).select("doc_id", *(F.lit("own").alias(c) for c in ("digest", "id", "node", "_digest", "c0", "row", "x", "digest_")), "text")
    kept = nd.one_of_each(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted([1, 200, 301, 303, 305, None], key=repr)
    assert {r[c] for r in got for c in df.columns[1:-1]} == {"own"}


def test_more_leave_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(nd, "BROADCAST_ROWS", 0)
    rows = [(i, f"text number {i // 3} of a few words and no more than that") for i in range(60)]
    assert sorted(r.doc_id for r in nd.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == list(range(0, 60, 3))


def block(texts: list[str]) -> dict:
    encoder = Encoder()
    for t in texts:
        encoder.add(t.encode())
    return dict(zip(("tokens", "lengths", "words"), encoder.row(), strict=True))


@pytest.mark.parametrize("part", [3, 1 << 16])
def test_shingles_of_a_block(part, monkeypatch):
    monkeypatch.setattr(nd, "PART", part)
    texts = ["a b c d e f", "", "a b", "a b c d e a b c d e", "x", "f " * 9, "a b c d e f"]
    s = nd.Shingles(block(texts), 5, 3)
    own = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    of = [set(s.place[s.bounds[i] : s.bounds[i + 1]].tolist()) for i in range(len(texts))]
    assert [len(x) for x in of] == [len(x) for x in own] and len(s.keys) == len(set().union(*own))
    assert all(len(of[i] & of[j]) == len(own[i] & own[j]) for i in range(len(texts)) for j in range(len(texts)))
    assert (np.diff(s.keys) > 0).all() and s.cutoffs[-1] == len(s.keys)


def test_shingles_take_ten_numbers_a_word_at_most():
    rng = np.random.default_rng(2)
    x = block([" ".join(f"w{i}" for i in rng.integers(0, 3000, 500)) for _ in range(1000)])
    tracemalloc.start()
    try:
        nd.Shingles(x, 5, 6)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 500_000 * 80
