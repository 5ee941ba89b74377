"""Pipeline health: errors, runs, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def redacted(context: Column) -> Column:
    """A context that is short and isn't JSON, else a word for it."""
    return F.when(context.isNull(), "unknown").when((F.length(context) <= 80) & ~context.like("{%"), context).otherwise("redacted")


def recent_errors(log: DataFrame, now: Column, hours: int) -> DataFrame:
    """Errors by function and context, without the log's mere notes; the fifty most frequent."""
    message = F.col("error_message")
    rows = log.where((F.col("created_at") > now - F.make_dt_interval(hours=F.lit(hours))) & message.isNotNull() & (message != "Function started") & ~message.like("Successfully aggregated%"))
    found = rows.groupBy("function_name", redacted(F.col("context")).alias("context")).agg(F.count(F.lit(1)).alias("error_count"), F.max("created_at").alias("last_seen"))
    return found.orderBy(F.desc("error_count"), F.desc("last_seen"), "function_name", "context").limit(50)


def is_noise(context: Column) -> Column:
    """Contexts of the log that tell of no error: summaries, traces of matching, notices of another attempt."""
    return F.coalesce(context.isin("summary", "match-debug") | context.endswith("-retry"), F.lit(False))


def without_nulls(**fields: Column) -> Column:
    """An object as JSON without the fields that are null."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "true"})


def latest_runs(runs: DataFrame, limit: int) -> DataFrame:
    rows = runs.orderBy(F.desc("started_at"), "id").limit(limit)
    seconds = (F.col("completed_at").cast("long") - F.col("started_at").cast("long")).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("id", "source", "status", zero("posts_found"), zero("net_new_rows"), F.get_json_object("metadata", "$.classification_queued").cast("long").alias("classification_queued"), seconds.alias("duration_seconds"), "started_at")


def is_healthy(status: Column) -> Column:
    """A run that brought something in, whole or in part."""
    return status.isin("success", "partial")


def summary(runs: DataFrame) -> DataFrame:
    """For each source its runs by status, the last one and the last healthy one, and what they queued and put off."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    number = lambda name: F.coalesce(F.sum(F.get_json_object("metadata", f"$.{name}").cast("long")), F.lit(0)).alias(name)
    return runs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_runs"), count("success"), count("partial"), count("failed"), count("running"),
        F.max_by("status", F.struct("started_at", "id")).alias("last_status"), number("classification_queued"), number("deferred"),
        F.max(F.when(is_healthy(F.col("status")), F.col("started_at"))).alias("last_healthy_at"),
    )


def alerts(
    health: DataFrame, runs: DataFrame, limits: DataFrame, computed: DataFrame, run_now: Column, now: Column, backlog: int = 500, failed: int = 50, recent_failed: int = 20,
    minutes: int = 60, lag: int = 90, lookback: int = 72, healthy_hours: int = 30,
) -> DataFrame:
    """(alert, subject, amount): a row for each check that fails.

    health: one row of queued, retrying, failed, recent_failed, oldest_queued_at. computed: one row with the time of the newest score (score_computed_at). limits: (source, hours) says
    how long each source may go without a run; one that has had none within ``lookback`` hours is stale too, with a null amount. A stale source gives no second alert for lacking a
    healthy run, which is one that succeeded in whole or in part.
    """
    age = lambda since, then, unit: F.floor((F.unix_micros(since) - F.unix_micros(then)) / (unit * 1_000_000) + 0.5)
    alert = lambda name, amount, fails: F.when(fails, F.struct(F.lit(name).alias("alert"), F.lit("").alias("subject"), amount.cast("long").alias("amount")))
    waiting, oldest = F.col("queued") + F.col("retrying"), age(now, F.col("oldest_queued_at"), 60)
    queue = F.array(alert("queue_backlog", waiting, waiting >= backlog), alert("queue_age", oldest, oldest >= minutes), alert("failed_total", F.col("failed"), F.col("failed") >= failed), alert("failed_recently", F.col("recent_failed"), F.col("recent_failed") >= recent_failed))
    late = age(now, F.col("score_computed_at"), 60)
    scores = F.array(alert("aggregation_lag", late, late.isNull() | (late >= lag)))
    recent = runs.where((F.col("started_at") >= run_now - F.make_dt_interval(hours=F.lit(lookback))) & (F.col("started_at") <= run_now))
    by_source = recent.groupBy("source").agg(F.max("started_at").alias("last_run"), F.max(F.when(is_healthy(F.col("status")), F.col("started_at"))).alias("last_ok"))
    rows = limits.join(by_source, "source", "left").withColumn("_age", age(run_now, F.col("last_run"), 3600)).withColumn("_ok", age(run_now, F.col("last_ok"), 3600))
    stale = F.col("_age").isNull() | (F.col("_age") >= F.col("hours"))
    poor = F.col("_ok").isNull() | (F.col("_ok") >= healthy_hours)
    sources = rows.where(stale | poor).select(F.when(stale, "source_stale").otherwise("source_no_success").alias("alert"), F.col("source").alias("subject"), F.when(stale, F.col("_age")).otherwise(F.col("_ok")).cast("long").alias("amount"))
    return health.select(F.inline(F.array_compact(queue))).unionByName(computed.select(F.inline(F.array_compact(scores)))).unionByName(sources)
