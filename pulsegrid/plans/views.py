"""Derived tables: the test tables seen as posts, models, runs, errors and a leaderboard, in Spark and in SQL.

``NOW`` stands for the current time, so that every query gives the same rows whenever it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.taxonomy import COMPLAINTS, PRAISES

NOW = "2024-01-31 00:00:00"
SOURCES = ["hackernews", "bluesky", "mastodon", "twitter", "reddit"]
MODELS = [("m0", "claude", "Claude", "#d97757"), ("m1", "chatgpt", "ChatGPT", "#10a37f"), ("m2", "gemini", "Gemini", "#4285f4"), ("m3", "grok", "Grok", "#111111")]
POSTED_COMPLAINTS = [*COMPLAINTS, "reliability", "other"]
ERRORS = ["quota exceeded", "request timeout", "parse failed", "api said 500", "transient glitch", "unknown trouble"]


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def ago(**span: int) -> Column:
    """NOW less days or hours."""
    return now() - F.make_dt_interval(**{k: F.lit(v) for k, v in span.items()})


def pick(values: list[str], place: Column) -> Column:
    """The value at a place from 0."""
    return F.element_at(F.array(*map(F.lit, values)), place.cast("int") + 1)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model_id string, slug string, name string, accent_color string")


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each (post, model)."""
    e = read(spark, folder, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind, i = F.col("event_type"), F.col("event_id")
    sentiment = F.when(kind.isin("purchase", "signup"), "positive").when(kind == "error", "negative").otherwise("neutral")
    status = F.when(k < 80, "classified").when(k < 86, "pending").when(k < 90, "retry").when(k < 94, "failed").otherwise("irrelevant")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        i.alias("id"),
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model_id"),
        pick(SOURCES, F.col("user_id") % 5).alias("source"),
        ts.alias("posted_at"),
        (ts + F.expr("interval 5 minutes")).alias("created_at"),
        sentiment.alias("sentiment"),
        status.alias("status"),
        ((i * 37 % 101) / F.lit(100.0)).alias("confidence"),
        F.floor("value").cast("int").alias("engagement"),
        F.when(i % 3 == 0, "title_only").otherwise("title_and_body").alias("content_type"),
        F.when(kind.isin("error", "click"), pick(POSTED_COMPLAINTS, k % len(POSTED_COMPLAINTS))).alias("complaint"),
        F.when(sentiment == "positive", pick(PRAISES, k % len(PRAISES))).alias("praise"),
        F.concat(F.lit("u"), (i - i % 3).cast("string")).alias("source_url"),
        (i % 6).cast("int").alias("attempts"),
        F.when(status.isin("pending", "retry") & (i % 4 != 0), ts + F.make_dt_interval(hours=(i % 72).cast("int"))).alias("next_at"),
        F.when(status == "failed", pick(ERRORS, i % len(ERRORS))).alias("error"),
        F.concat(F.lit("Post "), (i % 500).cast("string"), F.lit(" about "), F.col("event_type")).alias("title"),
        k.alias("k"),
    )


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


POSTS_SQL = f"""models AS (SELECT * FROM (VALUES {', '.join(str(m) for m in MODELS)}) m(model_id, slug, name, accent_color)),
raw AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INTEGER AS k,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment FROM events),
raw2 AS (SELECT *, CASE WHEN k < 80 THEN 'classified' WHEN k < 86 THEN 'pending' WHEN k < 90 THEN 'retry' WHEN k < 94 THEN 'failed' ELSE 'irrelevant' END AS status FROM raw),
posts AS (SELECT event_id AS id, 'm' || (user_id % 4) AS model_id, {sql_list(SOURCES)}[user_id % 5 + 1] AS source, ts AS posted_at, ts + INTERVAL 5 MINUTE AS created_at,
  sentiment, status, (event_id * 37 % 101) / 100.0::DOUBLE AS confidence, floor(value)::INTEGER AS engagement,
  CASE WHEN event_id % 3 = 0 THEN 'title_only' ELSE 'title_and_body' END AS content_type,
  CASE WHEN event_type IN ('error', 'click') THEN {sql_list(POSTED_COMPLAINTS)}[k % {len(POSTED_COMPLAINTS)} + 1] END AS complaint,
  CASE WHEN sentiment = 'positive' THEN {sql_list(PRAISES)}[k % {len(PRAISES)} + 1] END AS praise,
  'u' || (event_id - event_id % 3) AS source_url, (event_id % 6)::INTEGER AS attempts,
  CASE WHEN status IN ('pending', 'retry') AND event_id % 4 <> 0 THEN ts + to_hours(event_id % 72) END AS next_at,
  CASE WHEN status = 'failed' THEN {sql_list(ERRORS)}[event_id % {len(ERRORS)} + 1] END AS error,
  'Post ' || (event_id % 500) || ' about ' || event_type AS title, k FROM raw2)"""


def with_posts(rest: str) -> str:
    """SQL over the derived posts and models; ``rest`` begins with further tables (``, name AS (...)``) or SELECT."""
    return f"WITH RECURSIVE {POSTS_SQL}{rest if rest.startswith(',') else ' ' + rest}"


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Collector runs from orders."""
    o = read(spark, folder, "orders")
    started = F.col("o_orderdate").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "running").otherwise("success")
    return o.select(
        F.col("o_orderkey").alias("id"),
        pick(SOURCES, F.col("o_custkey") % 5).alias("source"),
        status.alias("status"),
        started.alias("started_at"),
        F.when(status != "running", started + F.make_dt_interval(secs=F.col("o_custkey").cast("decimal(18,6)"))).alias("completed_at"),
        (F.col("o_custkey") % 97).cast("int").alias("posts_found"),
        F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_custkey") % 31).cast("int")).alias("net_new_rows"),
        F.to_json(F.struct((F.col("o_custkey") % 11).cast("int").alias("classification_queued"), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_custkey") % 5).cast("int")).alias("deferred"))).alias("metadata"),
    )


RUNS_SQL = f"""runs AS (SELECT o_orderkey AS id, {sql_list(SOURCES)}[o_custkey % 5 + 1] AS source,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'running' ELSE 'success' END AS status, o_orderdate AS started_at,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_seconds(o_custkey) END AS completed_at,
  (o_custkey % 97)::INTEGER AS posts_found, CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey % 31)::INTEGER END AS net_new_rows,
  (o_custkey % 11)::INTEGER AS classification_queued, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 5)::INTEGER END AS deferred FROM orders)"""


def errors(spark: SparkSession, folder: str) -> DataFrame:
    """The error log, from error and click events."""
    e = read(spark, folder, "events").where(F.col("event_type").isin("error", "click"))
    i, k = F.col("event_id"), F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return e.select(
        i.alias("id"),
        F.concat(F.lit("fn"), (F.col("user_id") % 7).cast("string")).alias("function_name"),
        F.when(k % 10 == 0, "Function started").when(k % 10 == 1, F.concat(F.lit("Successfully aggregated scores "), k.cast("string"))).when(k % 10 != 2, F.concat(F.lit("failed with "), k.cast("string"))).alias("error_message"),
        F.when(k % 4 == 0, "fetch").when(k % 4 == 1, F.lit('{"a": 1}')).when(k % 4 == 2, F.repeat(F.lit("x"), 81)).alias("context"),
        F.when(k % 5 == 0, "critical").otherwise("error").alias("severity"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


ERRORS_SQL = """errors AS (SELECT event_id AS id, 'fn' || (user_id % 7) AS function_name,
  CASE WHEN k % 10 = 0 THEN 'Function started' WHEN k % 10 = 1 THEN 'Successfully aggregated scores ' || k WHEN k % 10 <> 2 THEN 'failed with ' || k END AS error_message,
  CASE k % 4 WHEN 0 THEN 'fetch' WHEN 1 THEN '{"a": 1}' WHEN 2 THEN repeat('x', 81) END AS context,
  CASE WHEN k % 5 = 0 THEN 'critical' ELSE 'error' END AS severity, ts AS created_at
  FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INTEGER AS k FROM events WHERE event_type IN ('error', 'click')) s)"""
