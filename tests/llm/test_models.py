"""Classifiers by held-out accuracy, nearest neighbours by recall, URL rules and mixing by brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import common, mixing, quality_classifier, toxicity_fm, url_filter, vector_hnsw
from pulsegrid.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.1"


def auc(score: np.ndarray, y: np.ndarray) -> float:
    rank = np.argsort(np.argsort(score, kind="stable")) + 1.0
    ones = y.sum()
    return (rank[y > 0].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.9), ("op8_quality", "quality", 0.8)])
def test_held_out_labels_are_told_apart(spark, name, label, least):
    scored = QUERIES[name](spark, SF).where("held_out")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.col(label).isNotNull()).select("doc_id", label)
    rows = scored.join(labels, "doc_id").toPandas()
    assert rows.score.between(0, 1).all() and auc(rows.score.to_numpy(), rows[label].to_numpy()) >= least


@pytest.mark.parametrize("kind", [toxicity_fm, quality_classifier])
def test_classifiers_without_labels_texts_or_rows(spark, kind):
    docs = spark.createDataFrame([(1, "a b c", 0.5), (2, None, 0.5), (2, "", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in kind.score(docs, kind.fit(docs, none), ["doc_id"]).collect()] == pytest.approx([0, 0, 0], abs=1e-6)
    assert kind.score(docs.limit(0), kind.fit(docs.limit(0), none), ["doc_id"]).count() == 0


@pytest.mark.parametrize(("kind", "label"), [(toxicity_fm, "toxic"), (quality_classifier, "quality")])
def test_repeated_ids_very_long_texts_and_clashing_names(spark, kind, label):
    rows = [(i, ("fine words here " if i % 2 else "vile slur there ") * (1 + i % 3)) for i in range(200)] + [(1, "vile slur there")] * 400 + [(None, None), (999, "vile words " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(0).alias(c) for c in ("target", "sample_id", "terms", "features", "id", "t", "k0")))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, 1), (None, 1)], f"doc_id long, {label} int").withColumn("text", F.lit("clash"))
    sample = common.labelled_sample(df, labels, label, 50).collect()
    assert len(sample) == 50 == len({r.doc_id for r in sample})
    scored = kind.score(df, kind.fit(df, labels, bound=150), ["doc_id", "target"]).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    mean = lambda odd: np.mean([r.score for r in scored if r.doc_id not in (None, 1, 999) and r.doc_id % 2 == odd])
    assert mean(1) > mean(0) + 0.3


def exact(rows: list[tuple], k: int, every: int) -> dict[int, list[int]]:
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = np.round(x @ x[q], 12)
        order = np.lexsort((ids, -s))
        out[int(ids[q])] = [int(i) for i in ids[order] if i != ids[q]][:k]
    return out


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + 0.7 * rng.normal(size=32)).tolist()) for i in range(3000)]
    got = vector_hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50, 5, shards=3).collect()
    want = exact(rows, 5, 50)
    found = {q: {r.vec_id for r in got if r.query_id == q} for q in want}
    assert sum(len(found[q] & set(want[q])) for q in want) / (5 * len(want)) >= 0.9
    assert all(sorted(r.rank for r in got if r.query_id == q) == [1, 2, 3, 4, 5] for q in want)


def test_copies_ties_and_vectors_that_take_no_part(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 90, 10)] + [(5, [0.0, 0.0]), (6, None), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [0.0, 2.0]), (None, [1.0, 1.0]), (50, [1.0, 0.0])]
    got = vector_hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50, 5).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == [10, 20, 30, 40, 50]
    assert [r.vec_id for r in got if r.query_id == 50] == [0, 10, 20, 30, 40]
    assert all(r.score == 1.0 for r in got)


def test_scaled_copies_are_ties_by_id(spark):
    rng = np.random.default_rng(5)
    one = rng.normal(size=16)
    rows = [(3 * i, (one * 2.0 ** (i % 40 - 20)).tolist()) for i in range(300)] + [(3 * i + 1, (one * (1 + i % 7)).tolist()) for i in range(50)] + [(3 * i + 2, rng.normal(size=16).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = vector_hnsw.nearest(df, 50, 5).collect()
    for q in (0, 150):
        found = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert set(found) == set([i for i in (0, 1, 3, 4, 6, 7) if i != q][:5])
    big = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e-200, 0.0]), (2, [0.0, 1e300])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in vector_hnsw.nearest(big, 50, 5).orderBy("query_id", "rank").collect()] == [(1, 1.0), (2, 0.0)]


def test_nearest_of_no_rows_unusable_rows_and_clashing_names(spark):
    schema = "vec_id long, embedding array<double>"
    assert vector_hnsw.nearest(spark.createDataFrame([], schema)).count() == 0
    assert vector_hnsw.nearest(spark.createDataFrame([(0, None), (50, [0.0]), (100, []), (150, [None])], schema)).count() == 0
    rows = [(i, [float(i), 1.0]) for i in range(100)] + [(7, [7.0, 1.0]), (200, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, schema).select("*", *(F.lit(1).alias(c) for c in ("id", "v", "key", "held", "shard", "rank", "score", "query_id")))
    got = vector_hnsw.nearest(df, 50, 5).collect()
    assert {r.query_id for r in got} == {0, 50} and all(r.vec_id != r.query_id and r.vec_id < 100 for r in got)
    assert {r.vec_id for r in got if r.query_id == 50} == set(exact(rows[:100], 5, 50)[50])


URLS = [
    ("https://Sub.Example.ORG/es/1?x", "sub.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org", "notexample.org", "", None, None),
    ("http://a.com/de/x#y", "a.com", "/de/x", "com/de/", "block"),
    ("http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
    ("no url", "", "", None, None),
    (None, "", "", None, None),
    ("http://casino-win.example.net/slots/1", "casino-win.example.net", "/slots/1", None, "block"),
    ("http://library.example.net/history/1", "library.example.net", "/history/1", None, "allow"),
]


def test_url_rules_come_before_the_model(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(df, URL_RULES, ["page_id"]).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict in (None, got[i].verdict) and got[i].verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0), URL_RULES, ["page_id"]).count() == 0


def test_mixing_takes_prefixes_that_meet_the_budget(spark):
    rows = [(i, f"{'w ' * (1 + i % 7)}", ["en", "de", None][i % 3], f"s{i % 4}") for i in range(300)] + [(300, None, "en", "s0"), (301, "", "de", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("epoch", F.lit("clash"))
    weights = {"lang": {"en": 3.0, "de": 1.0}}
    got = mixing.mix(df, ["doc_id"], {"lang": F.col("lang"), "source": F.col("source")}, weights, 0.5, 2, 7).collect()
    tokens = {r[0]: len((r[1] or "").split()) for r in rows}
    total = 0.5 * sum(tokens.values())
    capacity = {x: 2 * sum(tokens[r[0]] for r in rows if r[2] == x) for x in ("en", "de", None)}
    level = total / 5
    assert all(level * w <= capacity[x] for x, w in (("en", 3), ("de", 1), (None, 1)))  # no shortage here
    for lang, w in (("en", 3.0), ("de", 1.0), (None, 1.0)):
        for source in ("s0", "s1", "s2", "s3"):
            order = sorted((e, hashlib.md5(f"7|{e}|{r[0]}".encode()).hexdigest(), r[0]) for r in rows if (r[2], r[3]) == (lang, source) for e in (1, 2))
            before, want = 0, []
            for e, _, i in order:
                if before < level * w / 4 - 1e-9:
                    want.append((i, e))
                before += tokens[i]
            assert sorted((r.doc_id, r.epoch) for r in got if (r.lang, r.source) == (lang, source)) == sorted(want)
    assert mixing.mix(df.limit(0), ["doc_id"], {"lang": F.col("lang")}, weights, 0.5).count() == 0
