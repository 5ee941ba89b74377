"""Costs of usage by a history of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def priced(usage: DataFrame, prices: DataFrame, cached_part: float = 0.1) -> DataFrame:
    """Usage (model, at, input, output, cached; tokens) with its ``cost`` by the price (model, since, until, input_price, output_price; for a million) valid at its time.

    Cached input costs a part of the price. until is excluded, and null while a price holds. Where periods overlap the latest counts; where no price fits the cost is null. The ranges meet as an
    equi-join on the days that usage spans, so no usage is compared with a price of another day. Prices are few beside usage, but nothing rests on it.
    """
    span = usage.agg(F.min(F.to_date("at")).alias("first"), F.max(F.to_date("at")).alias("last")).first()
    days = F.sequence(F.greatest(F.to_date("since"), F.lit(span["first"]).cast("date")), F.least(F.coalesce(F.to_date("until"), F.lit(span["last"]).cast("date")), F.lit(span["last"]).cast("date")))
    held = prices.where(F.coalesce(F.to_date("until"), F.lit(span["last"]).cast("date")) >= F.lit(span["first"]).cast("date")).where(F.to_date("since") <= F.lit(span["last"]).cast("date")).where("until is null or until > since")
    by_day = held.select(F.col("model").alias("_model"), "since", "until", "input_price", "output_price", F.explode(days).alias("_day"))
    # a day's prices of a model as one short list, so that usage meets one row
    listed = by_day.groupBy("_model", "_day").agg(F.reverse(F.array_sort(F.collect_list(F.struct("since", "until", "input_price", "output_price")))).alias("_prices"))
    met = usage.withColumn("_day", F.to_date("at")).join(listed.withColumnRenamed("_day", "_on"), (F.col("model") == F.col("_model")) & (F.col("_day") == F.col("_on")), "left")
    fits = F.filter("_prices", lambda p: (p["since"] <= F.col("at")) & (p["until"].isNull() | (p["until"] > F.col("at"))))
    price = F.get(fits, F.lit(0))
    fresh = F.coalesce("input", F.lit(0)) - F.coalesce("cached", F.lit(0))
    cost = (fresh * price["input_price"] + F.coalesce("cached", F.lit(0)) * price["input_price"] * cached_part + F.coalesce("output", F.lit(0)) * price["output_price"]) / 1_000_000
    return met.withColumn("cost", cost).drop("_model", "_on", "_day", "_prices")


def by_day(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, day, calls, unpriced, cost, cost_per_1k): null costs where none of the day's calls has a price."""
    rows = priced(usage, prices).groupBy("model", F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("cost").isNull()).alias("unpriced"), F.round(F.sum("cost"), 9).alias("cost"), F.count("cost").alias("_n"))
    return rows.withColumn("cost_per_1k", F.round(F.col("cost") / F.nullif(F.col("_n"), F.lit(0)) * 1000, 9)).drop("_n")
