"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves of a tree of columns, by default domain, language and source. A token budget flows from the root:
siblings share their parent's budget by weight, none gets more than its subtree can give (its tokens in all epochs), and
what one can't take goes to its siblings first; only if all of them are full is it left to the parent's siblings. That is
a water level for each family: the least level L at which the sum of min(capacity, L * weight) meets the budget.

A leaf's share is filled from seeded epochs: in each, its documents follow one another by a seeded digest, and the leaf
takes the prefix of that order whose tokens fit: a document is taken while the tokens before it are fewer than the share.
The order's prefix sums are made in two steps, over ranges of the digest and within them, so that a leaf that holds a third
of all rows is no single task.

Defined results: null leaf values are a leaf of their own; null or empty texts hold no tokens, and are taken while the leaf's
share isn't met; repeated rows are taken each, in their digest's order; a value without a weight has weight one, and weight
zero gets nothing; an empty table gives an empty one; the words of a very long text are counted within one task; the tree's columns are named anew, so names of the
table clash with none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut


def token_count(text: str = "text") -> Column:
    """Words of a text: what lies between ASCII white space."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order_key(seed: int, epoch: Column | str, doc_id: str) -> Column:
    """Where a document stands in an epoch: hex digits that look random."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(epoch) if isinstance(epoch, str) else epoch, F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def weight(column: str, weights: dict[str, float] | None) -> Column:
    """The weight of a value among its siblings; one where the table names none."""
    pairs = [x for k, v in (weights or {}).items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.create_map(*pairs)[F.coalesce(F.col(column), F.lit(""))], F.lit(1.0)) if pairs else F.lit(1.0)


def water_fill(nodes: DataFrame, family: list[str]) -> DataFrame:
    """Add ``share`` to nodes (weight, capacity, budget of the family): how much of the budget each one gets."""
    by_fill = Window.partitionBy(*family).orderBy("ratio", *[c for c in nodes.columns if c.startswith("level_")])
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = F.try_divide(F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0)), F.sum("weight").over(after))
    ratio = F.coalesce(F.try_divide("capacity", "weight"), F.lit(float("inf")))
    filled = nodes.withColumn("ratio", ratio).withColumn("level", F.coalesce(level, F.lit(0.0)))
    # full nodes come first; the first that isn't full has the family's level, and later ones a lower figure
    first = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(Window.partitionBy(*family))
    share = F.when(F.col("ratio") > F.col("level"), first * F.col("weight")).otherwise(F.col("capacity"))
    return filled.withColumn("share", F.least("capacity", share)).drop("ratio", "level")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], total: float, epochs: int) -> DataFrame:
    """(level columns, share): what each leaf of (level columns, tokens) may give."""
    names = [f"level_{i}" for i in range(len(levels))]
    nodes = leaves.select(*(F.col(c).alias(n) for c, n in zip(levels, names, strict=True)), (F.col("tokens") * epochs).cast("double").alias("capacity"))
    done = None
    for depth in range(1, len(levels) + 1):
        here = nodes.groupBy(*names[:depth]).agg(F.sum("capacity").alias("capacity"))
        here = here.withColumn("weight", weight(names[depth - 1], weights.get(levels[depth - 1])))
        if done is None:
            here = here.withColumn("budget", F.lit(float(total)))
        else:
            up = done.select(*(F.col(n).alias(f"up_{n}") for n in names[: depth - 1]), F.col("share").alias("budget"))
            same = reduce(Column.__and__, (F.col(n).eqNullSafe(F.col(f"up_{n}")) for n in names[: depth - 1]))
            here = here.join(up, same).drop(*(f"up_{n}" for n in names))
        done = water_fill(here, names[: depth - 1])
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, levels, strict=True)), "share")


def mix(
    docs: DataFrame, keep: list[str], levels: dict[str, Column], weights: dict[str, dict[str, float]], share: float, epochs: int = 1, seed: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The chosen rows: ``keep`` columns, the level columns, epoch, tokens and tokens_before in the leaf's order.

    share: the budget as a part of all tokens of ``docs``. A document comes once for each epoch that takes it.

    Words are counted once: rows with their count and a number of their own are written, everything is decided on the narrow
    columns of that table, and the chosen rows are joined back by their number, which no two rows share.
    """
    names = [f"level_{i}" for i in range(len(levels))]
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    tagged = docs.select(*kept, *(e.alias(n) for n, e in zip(names, levels.values(), strict=True)), F.col(doc_id).alias("id"), token_count(text).alias("tokens"))
    wide = cut(tagged.withColumn("row", F.monotonically_increasing_id()), "mixing-rows")
    rows = wide.select(*names, "id", "tokens", "row")
    leaves = cut(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "leaves")
    size = leaves.agg(F.sum("tokens"), F.sum("rows")).first()
    # as many ranges as a range has rows: neither step of the sums has more than about the root of them in one group
    total, digits = share * float(size[0] or 0), max(1, -(-(size[1] or 0).bit_length() // 8))
    given = budgets(leaves, names, dict(zip(names, (weights.get(c, {}) for c in levels), strict=True)), total, epochs)

    # tokens before a range: sums of ranges, then within a leaf's epochs and ranges
    spread = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch")).withColumn("place", order_key(seed, "epoch", "id"))
    part = spread.withColumn("range", F.substring("place", 1, digits))
    ranges = part.groupBy(*names, "epoch", "range").agg(F.sum("tokens").alias("in_range"))
    leaf = Window.partitionBy(*names).orderBy("epoch", "range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(leaf), F.lit(0)))
    on = lambda a, b, cols: reduce(Column.__and__, (a[c].eqNullSafe(b[c]) for c in cols))
    quota = ranges.join(given, on(ranges, given, names)).select(*(ranges[c] for c in (*names, "epoch", "range", "before")), "share").where("before < share")
    quota = quota.select(*(F.col(c).alias(f"q_{c}") for c in (*names, "epoch", "range")), "before", "share")
    joined = part.join(quota, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"q_{c}")) for c in (*names, "epoch", "range"))))
    within = Window.partitionBy(*names, "epoch", "range").orderBy("place", "id", "tokens", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("tokens_before", F.col("before") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    chosen = placed.where(F.col("tokens_before") < F.col("share")).select("row", "epoch", "tokens_before")
    found = wide.join(chosen, "row")
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(F.col(n).alias(c) for n, c in zip(names, levels, strict=True)), "epoch", "tokens", "tokens_before")
