"""Mixing against a budget worked out by hand-made recursion, with shortages at two levels."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import mixing


def fill(budget: float, family: dict, weights: dict) -> dict:
    """What each member of a family gets: full ones leave their rest to their siblings."""
    given, open_ = {}, dict(family)
    while open_:
        level = budget / sum(weights.get(k, 1.0) for k in open_) if any(weights.get(k, 1.0) for k in open_) else 0.0
        full = {k for k, c in open_.items() if c <= level * weights.get(k, 1.0)}
        if not full:
            return given | {k: level * weights.get(k, 1.0) for k in open_}
        for k in full:
            given[k] = open_.pop(k)
            budget -= given[k]
    return given


def brute(rows: list[tuple], weights: dict, share: float, epochs: int, seed: int) -> list[tuple]:
    """Rows (doc_id, text, domain, lang, source) taken, with their epoch and the tokens before them."""
    tokens = lambda r: len((r[1] or "").split())
    capacity = lambda *path: epochs * sum(tokens(r) for r in rows if r[2 : 2 + len(path)] == path)
    children = lambda *path: sorted({r[2 + len(path)] for r in rows if r[2 : 2 + len(path)] == path}, key=str)
    out = []

    def walk(path: tuple, budget: float) -> None:
        if len(path) == 3:
            order = sorted((e, hashlib.md5(f"{seed}|{e}|{r[0]}".encode()).hexdigest(), r[0], tokens(r)) for r in rows if r[2:] == path for e in range(1, epochs + 1))
            before = 0
            for e, _, i, n in order:
                if before < budget - 1e-9:
                    out.append((i, e, before))
                before += n
            return
        given = fill(budget, {k: capacity(*path, k) for k in children(*path)}, weights.get(("domain", "lang", "source")[len(path)], {}))
        for k, x in given.items():
            walk((*path, k), x)

    walk((), share * sum(map(tokens, rows)))
    return sorted(out)


SCHEMA = "doc_id long, text string, domain string, lang string, source string"


def taken(df, weights, share, epochs=1, seed=3):
    levels = {c: F.col(c) for c in ("domain", "lang", "source")}
    return sorted((r.doc_id, r.epoch, r.tokens_before) for r in mixing.mix(df, ["doc_id"], levels, weights, share, epochs, seed).collect())


def test_shortages_go_to_siblings_before_ancestors(spark):
    rows = [(i, "w " * (1 + i % 5), ("d0", "d1", "d2")[i % 3], ("en", "de")[i % 2], f"s{i % 4}") for i in range(240)]
    rows += [(1000 + i, "w " * 40, "d1", "en", "s9") for i in range(30)]
    weights = {"domain": {"d0": 8.0, "d1": 1.0, "d2": 1.0}, "lang": {"en": 5.0, "de": 1.0}}
    total = sum(len(r[1].split()) for r in rows)
    assert sum(len(r[1].split()) for r in rows if r[2] == "d0") < 0.9 * 0.8 * total  # the first domain falls short in one epoch
    assert fill(100.0, {"en": 40.0, "de": 200.0}, weights["lang"]) == {"en": 40.0, "de": 60.0}
    df = spark.createDataFrame(rows, SCHEMA)
    for epochs in (1, 2):
        assert taken(df, weights, 0.9, epochs) == brute(rows, weights, 0.9, epochs, 3)


@pytest.mark.parametrize("share", [0.1, 0.5, 1.0])
def test_repeated_rows_very_long_texts_and_weight_zero(spark, share):
    rows = [(i, "a b c", "d0", ("en", None)[i % 2], "s0") for i in range(40)] + [(7, "a b c", "d0", None, "s0")] * 3
    rows += [(50, "x " * 200_000, "d1", "en", "s1"), (51, None, "d1", "en", "s1"), (52, "", "d1", "en", "s2"), (53, "z z", "d2", "en", "s0")]
    weights = {"domain": {"d2": 0.0}, "lang": {"en": 2.0}}
    df = spark.createDataFrame(rows, SCHEMA).withColumn("tokens", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("epoch", F.lit(0))
    got = taken(df, weights, share)
    assert got == brute(rows, weights, share, 1, 3)
    assert 53 not in {i for i, _, _ in got}
