"""Scores of models from posts: weights, source cap, daily and hourly scores, quality flags and smoothing.

Everything is one aggregation to cells (model, period, source, sentiment, complaint), which map-side combining keeps small, and
windows over those cells; a hot source is a handful of cells, whatever its posts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import taxonomy

MIN_CONFIDENCE = 0.65
MIN_POSTS = 5
ZONE = "America/Los_Angeles"


def half_up(x: Column) -> Column:
    """Round to whole numbers, halves up; sums that differ in the last bits round alike."""
    return F.floor(F.round(x, 9) + 0.5).cast("int")


def day_start(ts: Column, zone: str = ZONE) -> Column:
    """The instant at which the zone's day of ``ts`` began."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)), zone)


def day_label(ts: Column, zone: str = ZONE) -> Column:
    """The zone's date of an instant, as text."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def with_instant(rows: DataFrame, label: str, time: str, zone: str, name: str) -> DataFrame:
    """Add the instant at which a zone's clocks show a date (``label``) and a time (HH:mm).

    It starts from the same numbers read as UTC and corrects them by the zone's offset there, up to four times. A time that comes twice is its first coming; one that is left out ends at
    the hour before the gap, as the scores have always had it. Null if label or time can't be read.
    """
    base = F.try_to_timestamp(F.concat_ws(" ", label, time), F.lit("yyyy-MM-dd HH:mm"))
    rows = rows.withColumn("_base", base).withColumn("_guess", F.col("_base"))
    for _ in range(4):
        offset = F.unix_micros(F.from_utc_timestamp("_guess", zone)) - F.unix_micros("_guess")
        rows = rows.withColumn("_next", F.timestamp_micros(F.unix_micros("_base") - offset)).drop("_guess").withColumnRenamed("_next", "_guess")
    return rows.withColumn(name, F.col("_guess")).drop("_base", "_guess")


def day_window(rows: DataFrame, at: str, zone: str = ZONE) -> DataFrame:
    """Add label, range_start and range_end of the zone's day of an instant: 23 or 25 hours where clocks change."""
    labelled = rows.withColumn("label", day_label(F.col(at), zone)).withColumn("_next_day", F.date_format(F.date_add(F.to_date("label"), 1), "yyyy-MM-dd")).withColumn("_midnight", F.lit("00:00"))
    return with_instant(with_instant(labelled, "label", "_midnight", zone, "range_start"), "_next_day", "_midnight", zone, "range_end").drop("_next_day", "_midnight")


def is_classified(status: Column, sentiment: Column) -> Column:
    """Whether a post counts as classified; without a known status its sentiment decides."""
    known = F.when(status == "classified", True).when(status.isin("pending", "retry", "failed", "irrelevant"), False)
    return F.coalesce(known, taxonomy.sentiment(sentiment).isNotNull())


def weight(confidence: Column, content_type: Column, engagement: Column) -> Column:
    title = F.when(content_type == "title_only", 0.6).otherwise(1.0)
    reach = F.least(F.greatest(F.lit(1.0), F.ln(F.greatest(F.coalesce(engagement, F.lit(0)), F.lit(0)) + 1.0)), F.lit(math.log(1001)))
    return F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)) * title * reach


def source_cap(total: Column, largest: Column) -> Column:
    """Factor of the largest source: its share of the rest's weight is capped, more loosely if the rest is light."""
    rest = total - largest
    cap = F.when(rest >= 3, F.lit(0.5)).otherwise(0.5 + 0.5 * (1 - rest / 3))
    over = (rest > 0) & (largest > total * cap + F.lit(1e-9))
    return F.when(over, F.least(F.lit(1.0), F.try_divide(rest * cap, (1 - cap) * largest))).otherwise(1.0)


def cells(posts: DataFrame, period: Column) -> DataFrame:
    """Counts and weights of (model, period, source, sentiment, complaint), with weights after the source cap.

    Posts that don't score stay as cells without a sentiment, so that one pass over the posts counts them too.
    """
    confidence = F.coalesce(F.col("confidence"), F.lit(0.5))
    done = is_classified(F.col("status"), F.col("sentiment"))
    fine = F.coalesce(done & (confidence >= MIN_CONFIDENCE) & taxonomy.sentiment(F.col("sentiment")).isNotNull(), F.lit(False))
    rows = posts.select(
        "model_id", period.alias("period_start"), F.coalesce("source", F.lit("unknown")).alias("source"), F.when(fine, F.col("sentiment")).alias("sentiment"),
        F.when(fine & (F.col("sentiment") == "negative"), taxonomy.complaint(F.col("complaint"))).alias("category"),
        F.when(fine, weight(confidence, F.col("content_type"), F.col("engagement"))).otherwise(0.0).alias("w"), fine.alias("fine"), done.alias("done"), "status",
    )
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    small = rows.groupBy("model_id", "period_start", "source", "sentiment", "category").agg(
        F.sum("w").alias("w"), count(F.col("fine"), "n"), count(F.col("done"), "classified"),
        count(F.col("status").isin("pending", "retry"), "queued_posts"), count(F.col("status") == "failed", "failed_posts"),
    )
    own = Window.partitionBy("model_id", "period_start", "source")
    every = Window.partitionBy("model_id", "period_start")
    small = small.withColumn("source_w", F.sum("w").over(own))
    small = small.withColumn("total", F.sum("w").over(every)).withColumn("largest", F.max("source_w").over(every))
    factor = F.when(F.col("source_w") == F.col("largest"), source_cap(F.col("total"), F.col("largest"))).otherwise(1.0)
    return small.withColumn("factor", factor).withColumn("capped", F.col("w") * F.col("factor"))


def raw_scores(posts: DataFrame, period: Column) -> DataFrame:
    """Of each period with posts that score: raw_score, counts by sentiment and by state, eligible_posts, top_complaint."""
    key, states = ["model_id", "period_start"], ["classified", "queued_posts", "failed_posts"]
    parts = cells(posts, period)
    of = lambda s: F.sum(F.when(F.col("sentiment") == s, F.col("capped")).otherwise(0.0)).alias(f"{s}_w")
    count = lambda s: F.sum(F.when(F.col("sentiment") == s, F.col("n")).otherwise(0)).alias(f"{s}_count")
    kinds = ("positive", "negative", "neutral")
    by_category = parts.groupBy(*key, "category").agg(*map(of, kinds), *map(count, kinds), F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in states))
    total = lambda c: F.sum(f"{c}_w")
    whole = total("positive") + total("neutral") + total("negative")
    score = F.when(whole > 0, half_up(100 * (total("positive") + 0.5 * total("neutral")) / whole)).otherwise(50)
    heaviest = F.min(F.when(F.col("category").isNotNull(), F.struct((-F.round("negative_w", 9)).alias("order"), "category")))["category"]
    scored = by_category.groupBy(*key).agg(
        score.alias("raw_score"), *(F.sum(f"{s}_count").cast("long").alias(f"{s}_count") for s in kinds), F.sum("n").cast("long").alias("eligible_posts"),
        heaviest.alias("top_complaint"), *(F.sum(c).cast("long").alias(c) for c in states),
    )
    return scored.where("eligible_posts > 0")


def quality(rows: DataFrame) -> DataFrame:
    """Add total, coverage, basis and confidence to rows with classified, queued_posts, failed_posts, eligible_posts."""
    seen = F.col("classified") + F.col("queued_posts")
    total = seen + F.col("failed_posts")
    coverage = F.when(seen > 0, F.col("classified") / seen).otherwise(1.0)
    failed = F.when(total > 0, F.col("failed_posts") / total).otherwise(0.0)
    basis = F.when((F.col("queued_posts") > 5) | (coverage < 0.85) | (failed > 0.15), "partial_coverage").when(F.col("eligible_posts") < MIN_POSTS, "thin_sample").otherwise("measured")
    sure = F.when((F.col("eligible_posts") >= 10) & (coverage >= 0.85) & (basis == "measured"), "high").when((F.col("eligible_posts") >= 5) & (coverage >= 0.65), "medium").otherwise("low")
    return rows.select("*", total.alias("total_posts"), coverage.alias("classification_coverage"), basis.alias("score_basis_status"), sure.alias("score_confidence"))


def smoothing_weight(n: Column) -> Column:
    """How much of a new raw score counts, by its eligible posts."""
    ramp = F.when(n <= 1, 0.2).when(n <= 3, 0.3).when(n < MIN_POSTS, 0.4).when(n >= 2 * MIN_POSTS, 0.7)
    return ramp.otherwise(0.4 + (n - MIN_POSTS + 1) / F.lit(float(MIN_POSTS + 1)) * 0.3)


def smooth(scores: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Add ``score``: each model's raw scores folded in order of time, each one mixed with the score before it.

    seeds (model_id, seed): the score before the first one, where a model has one stored.
    """
    rest = [c for c in scores.columns if c not in ("model_id", "period_start")]
    points = scores.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("period_start", F.struct(*rest).alias("rest")))).alias("points"))
    points = points.join(F.broadcast(seeds.select("model_id", "seed")), "model_id", "left") if seeds is not None else points.withColumn("seed", F.lit(None).cast("int"))

    def step(done: Column, p: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1)), F.col("seed"))
        w = smoothing_weight(p["rest"]["eligible_posts"])
        return F.concat(done, F.array(F.when(before.isNull(), p["rest"]["raw_score"]).otherwise(half_up(w * p["rest"]["raw_score"] + (1 - w) * before))))

    folded = points.withColumn("scores", F.aggregate("points", F.array().cast("array<int>"), step))
    each = folded.select("model_id", F.explode(F.arrays_zip("points", "scores")).alias("x"))
    return each.select("model_id", "x.points.period_start", *(F.col(f"x.points.rest.{c}").alias(c) for c in rest), F.col("x.scores").alias("score"))


def daily(posts: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Daily scores; days without eligible posts have none, and smoothing goes on from the last day that has one."""
    rows = quality(raw_scores(posts, day_start(F.col("posted_at"))))
    return smooth(rows, seeds).withColumn("unclassified_posts", F.col("queued_posts") + F.col("failed_posts")).drop("classified")


def recompute(stored: DataFrame, posts: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Stored daily scores with those of the last ``days`` days (zone days, today included) made anew from the posts.

    Late and reclassified posts of these days thus heal their scores. The first day goes on from the score stored last before the
    window, so that the result is that of scoring all posts at once. Only posts of the window are read.
    """
    first = day_start(now - F.make_dt_interval(days=F.lit(days)))
    kept = stored.where(F.col("period_start") < first)
    seeds = kept.groupBy("model_id").agg(F.max_by("score", "period_start").alias("seed"))
    return kept.unionByName(daily(posts.where(F.col("posted_at") >= first), seeds).select(*stored.columns))


def hourly(posts: DataFrame, since: Column) -> DataFrame:
    """Unsmoothed scores of UTC hours from ``since`` on."""
    hour = F.date_trunc("hour", F.col("posted_at"))
    rows = quality(raw_scores(posts.where(F.col("posted_at") >= since), hour))
    return rows.withColumn("score", F.col("raw_score")).drop("classified", "raw_score")


def vibe_label(score: Column) -> Column:
    return F.when(score <= 40, "negative").when(score <= 65, "mixed").when(score.isNotNull(), "positive")
