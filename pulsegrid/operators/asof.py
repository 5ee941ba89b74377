"""Backward as-of join: to each row the latest point of its key before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(rows: DataFrame, points: DataFrame, key: list[str], at: str, point_at: str, values: list[str], strict: bool = True, width: int = 86_400) -> DataFrame:
    """``rows`` with the ``values`` and time (``point_at``) of the latest of ``points`` with their key before ``at``; nulls if there is none.

    strict: a point at the row's own time doesn't count. Of points with equal key and time the one with the largest values counts. Rows with a null key or
    time meet none.

    Both sides are united and sorted by time, and the last point is carried along, so no pair is ever compared. A key's history is cut into slices of
    ``width`` seconds, and each slice is sorted on its own, so that a key with a third of all rows is spread; a table of each slice's last point,
    at most one row a slice, tells what the slices before carry over.
    """
    usable = F.lit(True)
    for c in [*key, at]:
        usable = usable & F.col(f"r.{c}").isNotNull()
    point = F.struct(F.col(point_at).alias("t"), *(F.col(c).alias(f"v{i}") for i, c in enumerate(values)))
    known = points.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*key, point_at])).groupBy(*(F.col(c).alias(f"k{i}") for i, c in enumerate(key)), F.col(point_at).alias("t")).agg(F.max(point).alias("p"))
    keys = [f"k{i}" for i in range(len(key))]
    # at equal times a row comes before the point if the point doesn't count for it
    left = rows.select(F.struct("*").alias("r")).select("r", usable.alias("usable"), *(F.col(f"r.{c}").alias(k) for k, c in zip(keys, key, strict=True)), F.col(f"r.{at}").alias("t"))
    none = F.lit(None).cast(known.schema["p"].dataType)
    asked = left.where("usable").select(*keys, "t", F.lit(0 if strict else 1).alias("side"), "r", none.alias("p"))
    both = asked.unionByName(known.select(*keys, "t", F.lit(1 if strict else 0).alias("side"), F.lit(None).cast(left.schema["r"].dataType).alias("r"), "p"))
    slice_of = F.floor(F.unix_seconds(F.col("t").cast("timestamp")) / width)
    both = both.withColumn("slice", slice_of)
    ends = known.groupBy(*keys, slice_of.alias("slice")).agg(F.max("p").alias("end"))
    # what a slice is handed: the end of the last slice before it that has points
    slices = asked.select(*keys, slice_of.alias("slice"), F.lit(None).cast(known.schema["p"].dataType).alias("end")).distinct().unionByName(ends)
    slices = slices.groupBy(*keys, "slice").agg(F.max("end").alias("end"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = slices.select(*keys, "slice", F.last("end", ignorenulls=True).over(before).alias("handed"))
    run = Window.partitionBy(*keys, "slice").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("p", F.last("p", ignorenulls=True).over(run)).where("r IS NOT NULL")
    met = met.join(handed, [*keys, "slice"], "left").select("r", F.coalesce("p", "handed").alias("p"))
    met = met.unionByName(left.where("NOT usable").select("r", none.alias("p")))
    return met.select("r.*", *(F.col(f"p.v{i}").alias(c) for i, c in enumerate(values)), F.col("p.t").alias(point_at))
