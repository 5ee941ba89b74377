"""Filter interaction audit: what each filter removes in each order of filters, and its Shapley share, by part of the corpus.

Five filters judge a whole text: too few words, too few distinct ones, too many capitals, unwanted signs, and an exact copy of
a text with a smaller id. A document's failures are a mask of five bits, so all that an order of filters can do to a part of the
corpus follows from at most 32 counts. They form the part's removal polynomial: the multilinear extension of "documents removed
if these filters run",

    f(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i)),

held as integer coefficients of the subsets of filters. Its value at a corner is what a set of filters removes, which gives the survivors
of each step; the partial derivative in a filter's direction, integrated along the diagonal with exact rationals, is the filter's Shapley
value, and 120 times that is a whole number: what the filter removes, summed over all 120 orders. The same polynomial of good and of toxic documents'
counts gives what is lost of them.

Copies are told by the SHA-256 of whole texts, but no text travels and no group of copies is gathered: rows are counted by (digest, part,
labels) before each shuffle, and of a digest only these counts with their smallest ids meet, at most four for each part.

Defined results: a null text is empty and a null part is the empty string; a null id is never smaller than another nor larger, so
its row never fails as a copy and has no labels; rows that repeat an id and its text are all counted, and aren't copies of each other; an id with
several labels counts as good or toxic if any says so; no documents give no rows; a very long text is one value in one task, in a few times its size;
further columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations, permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import map_texts

#: The filters' letters; bit i of a mask stands for letter i.
FILTERS = "ABCDE"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
FOLLOWING = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rules:
    """Limits of the filters A to D; E has none."""

    min_words: int = 200
    min_distinct_pct: int = 50
    max_capitals_pct: int = 3
    signs: str = "#$%&*|"

    def mask(self, text: bytes) -> int:
        """Which of A to D a text (UTF-8) fails."""
        words = text.split()  # of bytes: at runs of the six ASCII white spaces
        capitals = len(text) - len(text.translate(None, CAPITALS))
        points = len(text) - len(text.translate(None, FOLLOWING)) if not text.isascii() else 0
        signs = self.signs.encode()
        return (
            (len(words) < self.min_words)
            | (100 * len(set(words)) < self.min_distinct_pct * len(words)) << 1
            | (100 * capitals > self.max_capitals_pct * (len(text) - points)) << 2
            | (len(text.translate(None, signs)) < len(text)) << 3
        )


Polynomial = dict[frozenset[int], int]


def removal_polynomial(counts: dict[int, int], filters: int = len(FILTERS)) -> Polynomial:
    """Coefficients by subset of the filters: ``counts`` says how many documents fail exactly the filters of a mask."""
    found: Polynomial = {}
    for mask, n in counts.items():
        failed = [i for i in range(filters) if mask >> i & 1]
        for size in range(1, len(failed) + 1):
            for subset in combinations(failed, size):  # of 1 - product of (1 - x_i)
                key = frozenset(subset)
                found[key] = found.get(key, 0) + (n if size % 2 else -n)
    return found


def at_corner(polynomial: Polynomial, chosen: frozenset[int]) -> int:
    """Documents that the chosen filters remove: the value where their variables are one and the others zero."""
    return sum(c for subset, c in polynomial.items() if subset <= chosen)


def shapley(polynomial: Polynomial, i: int) -> Fraction:
    """The partial derivative for filter ``i``, integrated over the diagonal from 0 to 1."""
    return sum((Fraction(c, len(subset)) for subset, c in polynomial.items() if i in subset), Fraction(0))


def orders_of(counts: pd.DataFrame) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from a part's counts (mask, n, good, toxic)."""
    every, good, toxic = (removal_polynomial(dict(zip(counts["mask"].tolist(), counts[c].tolist(), strict=True))) for c in ("n", "good", "toxic"))
    total, filters = int(counts["n"].sum()), range(len(FILTERS))
    corners = {s: [at_corner(p, s) for p in (every, good, toxic)] for size in range(len(FILTERS) + 1) for s in map(frozenset, combinations(filters, size))}
    whole = frozenset(filters)
    alone = [corners[frozenset([i])][0] for i in filters]
    unique = [corners[whole][0] - corners[whole - {i}][0] for i in filters]
    shares = [int(math.factorial(len(FILTERS)) * shapley(every, i)) for i in filters]
    rows = []
    for order in permutations(filters):
        name, before = "".join(FILTERS[i] for i in order), frozenset()
        for step, i in enumerate(order, 1):
            after = before | {i}
            removed, good_lost, toxic_lost = (b - a for a, b in zip(corners[before], corners[after], strict=True))
            rows.append((name, step, total - corners[after][0], removed, alone[i] - removed, unique[i], good_lost, toxic_lost, shares[i]))
            before = after
    return rows


def judged(docs: DataFrame, part: str, doc_id: str, text: str, rules: Rules) -> DataFrame:
    """(part, id, mask, digest): the failures of A to D and the digest of each whole text."""

    def make() -> Callable[[list[bytes]], list]:
        def run(texts: list[bytes]) -> list:
            return [pa.array([rules.mask(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]

        return run

    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(doc_id).alias("id"), F.col(text).alias("t"))
    return map_texts(rows, make, "mask int, digest binary", ["part", "id"], "t")


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of a mask."""
    bit = 1 << FILTERS.index("E")
    marked = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id"))
    marked = marked.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = judged(docs, part, doc_id, text, rules).groupBy("digest", "mask", "part", "id").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(marked, "id", "left").select("digest", "mask", "part", "id", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    # ids of a group: their smallest with its rows, and the rows without an id
    small = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    grouped = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), small, F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = grouped.groupBy("digest").agg(F.min("first.id").alias("least"))
    met = grouped.join(least, "digest")
    passing = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"), (F.col("n") - passing).alias("n")))
    split = met.select("part", "good", "toxic", F.explode(both).alias("b"))
    counted = {"n": F.col("b.n"), "good": F.when(F.col("good"), F.col("b.n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("b.n")).otherwise(0)}
    return split.groupBy("part", F.col("b.mask").alias("mask")).agg(*(F.sum(c).alias(k) for k, c in counted.items()))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:  # at most 32 rows
        found = pd.DataFrame(orders_of(counts), columns=names)
        found.insert(0, "part", key[0])
        return found

    schema = f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in names[2:])}"
    return mask_counts(docs, labels, part, doc_id, text, rules).groupBy("part").applyInPandas(run, schema)
