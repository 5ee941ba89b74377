"""Operators on dated rows: latest rows, trends, anomalies, band joins, grids, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(asked: int | None, default: int, most: int) -> int:
    """A row limit between 1 and ``most``."""
    return min(max(default if asked is None else asked, 1), most)


def latest(rows: DataFrame, key: list[str], at: str, n: int, tie: str | None = None) -> DataFrame:
    """The n latest rows of each key; a unique ``tie`` column settles equal times."""
    order = [F.desc(at), *([F.desc(tie)] if tie else [])]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def page(rows: DataFrame, at: str, tie: str, before: tuple | None, size: int) -> DataFrame:
    """A page of rows, newest first, after the (time, tie) that ended the last page; equal times lose no row."""
    if before:
        when, last = F.lit(before[0]).cast("timestamp"), F.lit(before[1])
        rows = rows.where((F.col(at) < when) | ((F.col(at) == when) & (F.col(tie) < last)))
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(size)


def trend(scores: DataFrame) -> DataFrame:
    """Add change against the score before, and its direction."""
    before = F.lag("score").over(Window.partitionBy("model_id").orderBy("period_start"))
    change = F.col("score") - before
    return scores.withColumn("change", change).withColumn("direction", F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("flat"))


def anomalies(scores: DataFrame, days: int = 14, least: int = 3) -> DataFrame:
    """Measured scores against the mean and deviation of measured scores in the days before."""
    measured = (F.col("score_basis_status") == "measured") & (F.col("eligible_posts") >= 5)
    window = Window.partitionBy("model_id").orderBy(F.col("period_start").cast("long")).rangeBetween(-days * 86400, -1)
    base = F.when(measured & (F.col("total_posts") > 0), F.col("score"))
    rows = scores.withColumn("n", F.count(base).over(window)).withColumn("baseline_mean", F.avg(base).over(window)).withColumn("_dev", F.stddev_samp(base).over(window))
    rows = rows.where((F.col("n") >= least) & measured & (F.col("classification_coverage") >= 0.8))
    rows = rows.withColumn("baseline_stddev", F.greatest(F.coalesce("_dev", F.lit(0.0)), F.lit(1.0))).withColumn("z", (F.col("score") - F.col("baseline_mean")) / F.col("baseline_stddev"))
    return rows.drop("_dev", "n").withColumn("severity", F.when(F.abs("z") >= 3, "breach").when(F.abs("z") >= 2, "watch").otherwise("normal"))


def within_days(events: DataFrame, marks: DataFrame, days: int) -> DataFrame:
    """Events (model_id, event_date, ...) with the labels of marks (model_id, day, label) at most ``days`` away.

    A band join as an equi-join: each mark is met on every day of its band, so no pair is compared that doesn't match.
    """
    near = marks.select("model_id", F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))).alias("event_date"), F.col("day").alias("_day"), "label")
    met = near.groupBy("model_id", "event_date").agg(F.array_sort(F.collect_list(F.struct("_day", "label")))["label"].alias("found"))
    return events.join(met, ["model_id", "event_date"], "left").withColumn("matches", F.coalesce(F.concat_ws(",", "found"), F.lit(""))).drop("found")


def grid(keys: DataFrame, rows: DataFrame, last: str, days: int) -> DataFrame:
    """Every key on each of the days up to ``last``, with the rows' values or nulls."""
    end = F.lit(last).cast("date")
    spine = keys.withColumn("day", F.explode(F.sequence(F.date_sub(end, days - 1), end)))
    return spine.join(rows, [*keys.columns, "day"], "left")


def carried(basis: Column, total: Column) -> Column:
    """Whether a day's score is one carried forward, by its basis or because it had no posts; a day without a score is not."""
    return F.coalesce((basis == "carried_forward") | (total == 0), F.lit(False))


def between(rows: DataFrame, at: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows from ``since`` to ``until``, both included, either of which may be open."""
    for bound, keep in ((since, lambda t: F.col(at) >= t), (until, lambda t: F.col(at) <= t)):
        if bound is not None:
            rows = rows.where(keep(F.lit(bound).cast("timestamp")))
    return rows


def difference(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys whose value differs between two tables, or is in one alone."""
    a, b = old.select(*key, F.col(value).alias(f"old_{value}")), new.select(*key, F.col(value).alias(f"new_{value}"))
    both = a.join(b, key, "full_outer").where(~F.col(f"old_{value}").eqNullSafe(F.col(f"new_{value}")))
    return both.withColumn("delta", F.col(f"new_{value}") - F.col(f"old_{value}"))


def y_domain(scores: DataFrame, pad: int = 5, step: int = 5, span: int = 30) -> DataFrame:
    """Bounds of a chart's axis: padded, on multiples of the step, not narrower than the span."""
    bounds = scores.groupBy("model_id").agg(
        F.greatest(F.lit(0), F.floor((F.min("score") - pad) / step) * step).cast("int").alias("lo"), F.least(F.lit(100), F.ceil((F.max("score") + pad) / step) * step).cast("int").alias("hi")
    )
    width = F.col("hi") - F.col("lo")
    low = F.when(width < span, F.greatest(F.lit(0), F.col("lo") - F.floor((span - width) / 2))).otherwise(F.col("lo"))
    return bounds.select("model_id", low.cast("int").alias("y_min"), F.when(width < span, F.least(F.lit(100), low + span)).otherwise(F.col("hi")).cast("int").alias("y_max"))
