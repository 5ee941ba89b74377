"""Vendors' events beside a model's days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_models(models: DataFrame, events: DataFrame) -> DataFrame:
    """Events (vendor, model_slug, ...) of each model (slug, vendor): its own, and those of its vendor that name no model.

    Two joins on keys instead of one on a condition with OR.
    """
    own = models.join(events.where("model_slug is not null").drop("vendor"), F.col("slug") == F.col("model_slug"))
    common = models.join(events.where("model_slug is null"), "vendor")
    columns = ["slug", *(c for c in events.columns if c not in ("vendor", "model_slug"))]
    return own.select(*columns).unionByName(common.select(*columns))


def markers(days: DataFrame, events: DataFrame) -> DataFrame:
    """Events (slug, title, start, end) on the days (slug, day) that a chart shows: clamped to its ends and moved onto shown days."""
    span = days.groupBy("slug").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    seen = events.withColumn("end", F.coalesce("end", "start")).join(span, "slug").where("end >= first and start <= last")
    met = seen.join(days, "slug").groupBy("slug", "title", "start", "end").agg(
        F.min(F.when(F.col("day") >= F.greatest("start", "first"), F.col("day"))).alias("from_day"), F.max(F.when(F.col("day") <= F.least("end", "last"), F.col("day"))).alias("to_day")
    )
    return met.where("from_day is not null and to_day is not null").select("slug", "title", "from_day", F.when(F.col("from_day") != F.col("to_day"), F.col("to_day")).alias("to_day"))
