"""Incidents of vendors beside falls of scores, joined as streams within days of each other.

Both sides wait in state for partners until their watermark has passed the span, so state is bounded by lateness and span, and an incident without
any fall is given out once none can come. A landing folder may get a closing row far in the future, which carries the watermarks past all that came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def near_falls(incidents: DataFrame, falls: DataFrame, days: int, lateness: str) -> DataFrame:
    """Incidents (event_id, model_slug, event_day) with each fall (fall_slug, fall_day, z) of their model at most ``days`` away, or with nulls."""
    left, right = incidents.withWatermark("event_day", lateness), falls.withWatermark("fall_day", lateness)
    span = F.expr(f"interval {days} days")  # a literal, which bounds the state
    near = (F.col("model_slug") == F.col("fall_slug")) & (F.col("fall_day") >= F.col("event_day") - span) & (F.col("fall_day") <= F.col("event_day") + span)
    return left.join(right, near, "left_outer").drop("fall_slug")


def falls_of(anomalies: DataFrame, slug: Column) -> DataFrame:
    """Anomalies as falls: those that are not normal and below the mean, by UTC day."""
    fallen = anomalies.where((F.col("severity") != "normal") & (F.col("z") < 0))
    return fallen.select(slug.alias("fall_slug"), F.date_trunc("day", "period_start").alias("fall_day"), "z")


def run_available(rows: DataFrame, folder: str) -> DataFrame:
    """Append what both streams give now to a table; the table so far. A later call with the same folder goes on where this one ended."""
    rows.writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").format("parquet").option("path", f"{folder}/table").start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/table")
