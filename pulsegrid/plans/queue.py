"""Queries of the work queue, its repairs and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import queue, upserts
from pulsegrid.plans.views import NOW, RUNS_SQL, ago, models, now, posts, read, runs, with_posts

N = f"TIMESTAMP '{NOW}'"


def due_work(spark: SparkSession, folder: str) -> DataFrame:
    return queue.due(posts(spark, folder), ago(days=2), 200).select("id", "model_id", "status", "posted_at")


def results(rows: DataFrame) -> DataFrame:
    """Results of a classifier, made up from the id."""
    i = F.col("id")
    status = F.when(i % 5 == 0, "api_error").when(i % 7 == 0, "quota_deferred").otherwise("ok")
    return rows.select(
        "*", status.alias("result_status"), (i % 3 != 0).alias("relevant"), F.when(i % 2 == 0, "positive").otherwise("negative").alias("result_sentiment"), ((i % 100) / 100.0).alias("result_confidence"),
        F.when(i % 10 == 0, "api said no").alias("result_error"), F.when(i % 35 == 0, 60000).alias("retry_after_ms"),
    )


def state_transition(spark: SparkSession, folder: str) -> DataFrame:
    waiting = posts(spark, folder).where(F.col("status").isin("pending", "retry"))
    return queue.transition(results(waiting), now())


TRANSITION_SQL = f""", res AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'api_error' WHEN id % 7 = 0 THEN 'quota_deferred' ELSE 'ok' END AS rs, id % 3 <> 0 AS rel, attempts + 1 AS na,
  CASE WHEN id % 35 = 0 THEN 60 ELSE least(86400, 900 * pow(2, greatest(attempts, 0)))::BIGINT END AS wait FROM posts WHERE status IN ('pending', 'retry')),
st AS (SELECT *, rs <> 'ok' AS failed, rs <> 'ok' AND na >= 5 AND rs <> 'quota_deferred' AS final FROM res)
SELECT id, CASE WHEN final THEN 'failed' WHEN failed THEN 'retry' WHEN NOT rel THEN 'irrelevant' ELSE 'classified' END AS status, na::INTEGER AS attempts,
  CASE WHEN failed AND NOT final THEN {N} + to_seconds(wait) END AS next_at, CASE WHEN NOT failed THEN {N} END AS classified_at,
  CASE WHEN failed THEN coalesce(CASE WHEN id % 10 = 0 THEN 'api said no' END, rs) END AS error,
  CASE WHEN NOT failed AND rel THEN CASE WHEN id % 2 = 0 THEN 'positive' ELSE 'negative' END END AS sentiment,
  CASE WHEN failed THEN NULL WHEN rel THEN (id % 100) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM st"""


def retry_backoff(spark: SparkSession, folder: str) -> DataFrame:
    waiting = posts(spark, folder).where("status = 'retry'")
    return waiting.groupBy("attempts").agg(F.count(F.lit(1)).alias("n")).select("attempts", "n", queue.backoff_seconds(F.col("attempts")).alias("wait_seconds"))


def queue_health(spark: SparkSession, folder: str) -> DataFrame:
    return queue.health(posts(spark, folder))


def failed_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Recent failures by kind of error, the ten largest kinds."""
    rows = posts(spark, folder).where((F.col("status") == "failed") & (F.col("posted_at") >= ago(days=14))).join(F.broadcast(models(spark)), "model_id")
    found = rows.groupBy(queue.error_group(F.col("error")).alias("error_group")).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("slug"))).alias("model_slugs"), F.min("posted_at").alias("oldest_failed_at"))
    return found.orderBy(F.desc("n"), "error_group").limit(10)


def reset_failed(spark: SparkSession, folder: str) -> DataFrame:
    """The made-up posts' errors have marks of their own, the same as in the SQL."""
    return queue.reset_failed(posts(spark, folder), ["timeout", "quota", "transient"]).select("id", "status", "attempts")


def multi_model(spark: SparkSession, folder: str) -> DataFrame:
    return queue.many_models(posts(spark, folder))


def stuck_runs_repair(spark: SparkSession, folder: str) -> DataFrame:
    return upserts.stuck_runs(runs(spark, folder), now())


def retention(spark: SparkSession, folder: str) -> DataFrame:
    return upserts.retained(posts(spark, folder), "posted_at", now(), 14).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def usage_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Token counters of line items added to those of earlier orders."""
    li = read(spark, folder, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_returnflag").alias("tier"), F.lit(1).cast("long").alias("calls"), F.col("l_quantity").cast("long").alias("tokens"), F.col("l_linenumber"))
    ledger = li.where("l_linenumber = 1").groupBy("month", "tier").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))
    return upserts.add_up(ledger, li.where("l_linenumber > 1").drop("l_linenumber"), ["month", "tier"], ["calls", "tokens"])


def insert_ignore_upsert(spark: SparkSession, folder: str) -> DataFrame:
    p = posts(spark, folder)
    stored = p.where("source = 'twitter'").groupBy("source_url", "model_id").agg(F.min("id").alias("id"))
    return upserts.insert_ignore(stored, p.where("source <> 'twitter'").select("source_url", "model_id", "id"), ["source_url", "model_id"], ["id"])


def conditional_upsert(spark: SparkSession, folder: str) -> DataFrame:
    p = posts(spark, folder).select("id", "status", "attempts", "next_at", "error", "posted_at")
    queued = p.where("id % 4 = 1").select("id", F.lit(3).alias("attempts"), F.col("posted_at").alias("next_at"), F.lit("queued").alias("error"))
    return upserts.requeue(p, queued)


def merge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals of a recomputed range over the stored ones."""
    o = read(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    return upserts.merge(o, o.where("month >= '1997-01'").withColumn("n", F.col("n") * 10), ["month", "priority"])


def classify_posts(spark: SparkSession, folder: str) -> DataFrame:
    """The stand-in classifier's sentiments against the stored ones."""
    p = posts(spark, folder)
    said = queue.classify(p, queue.lexicon_classifier, "sentiment string, relevant boolean").withColumnRenamed("sentiment", "said")
    return p.join(said, "id").groupBy("sentiment", "said").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "due_work": due_work,
    "state_transition": state_transition,
    "retry_backoff": retry_backoff,
    "classification_queue_health": queue_health,
    "failed_summary": failed_summary,
    "reset_failed": reset_failed,
    "multi_model_misclassified": multi_model,
    "stuck_runs_repair": stuck_runs_repair,
    "retention_cleanup": retention,
    "usage_ledger_upsert": usage_ledger,
    "insert_ignore_upsert": insert_ignore_upsert,
    "conditional_upsert": conditional_upsert,
    "merge_upsert": merge_upsert,
    "classify_posts": classify_posts,
}
_B = "CASE WHEN {0} = 0 THEN 0 WHEN {0} < 50 THEN 1 WHEN {0} < 500 THEN 50 ELSE 500 END::INTEGER"
_LI = "SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS tier, count(*) AS calls, sum(l_quantity::BIGINT)::BIGINT AS tokens FROM lineitem GROUP BY 1, 2"
ORACLE = {
    "due_work": with_posts(f"SELECT id, model_id, status, posted_at FROM posts WHERE status IN ('pending', 'retry') AND (next_at IS NULL OR next_at <= {N} - INTERVAL 2 DAY) ORDER BY next_at NULLS FIRST, posted_at, id LIMIT 200"),
    "state_transition": with_posts(TRANSITION_SQL),
    "retry_backoff": with_posts("SELECT attempts, count(*) AS n, least(86400, 900 * pow(2, greatest(attempts - 1, 0)))::BIGINT AS wait_seconds FROM posts WHERE status = 'retry' GROUP BY attempts"),
    "classification_queue_health": with_posts(f"SELECT {_B.format('p')} AS queued, {_B.format('r')} AS retrying, {_B.format('f')} AS failed, oldest_queued_at, next_attempt_at FROM (SELECT count(*) FILTER (WHERE status = 'pending') AS p, count(*) FILTER (WHERE status = 'retry') AS r, count(*) FILTER (WHERE status = 'failed') AS f, min(created_at) FILTER (WHERE status IN ('pending', 'retry')) AS oldest_queued_at, min(next_at) FILTER (WHERE status IN ('pending', 'retry')) AS next_attempt_at FROM posts)"),
    "failed_summary": with_posts(f"SELECT error_group, count(*) AS n, string_agg(DISTINCT slug, ',' ORDER BY slug) AS model_slugs, min(posted_at) AS oldest_failed_at FROM (SELECT CASE WHEN error ILIKE '%quota%' THEN 'quota' WHEN error ILIKE '%timeout%' OR error ILIKE '%abort%' THEN 'timeout' WHEN error ILIKE '%parse%' OR error ILIKE '%json%' THEN 'parse' WHEN error ILIKE '%api%' OR error ILIKE '%fetch%' THEN 'api' WHEN error ILIKE '%transient%' THEN 'transient' ELSE 'other' END AS error_group, slug, posted_at FROM posts JOIN models USING (model_id) WHERE status = 'failed' AND posted_at >= {N} - INTERVAL 14 DAY) GROUP BY error_group ORDER BY n DESC, error_group LIMIT 10"),
    "reset_failed": with_posts("SELECT id, 'pending' AS status, 0 AS attempts FROM posts WHERE status = 'failed' AND (error ILIKE '%timeout%' OR error ILIKE '%quota%' OR error ILIKE '%transient%')"),
    "multi_model_misclassified": with_posts("SELECT source_url, count(DISTINCT model_id) AS n_models, min(sentiment) AS sentiment FROM posts WHERE status = 'classified' GROUP BY source_url HAVING count(DISTINCT model_id) >= 2 AND count(DISTINCT sentiment) = 1"),
    "stuck_runs_repair": f"WITH {RUNS_SQL} SELECT id, CASE WHEN s THEN 'failed' ELSE status END AS status, CASE WHEN s THEN {N} ELSE completed_at END AS completed_at, CASE WHEN s THEN 'stuck for over 30 minutes' ELSE '' END AS message FROM (SELECT *, status = 'running' AND started_at < {N} - INTERVAL 30 MINUTE AS s FROM runs)",
    "retention_cleanup": with_posts(f"SELECT status, count(*) AS n FROM posts WHERE posted_at >= {N} - INTERVAL 14 DAY GROUP BY status"),
    "usage_ledger_upsert": _LI,
    "insert_ignore_upsert": with_posts(", s AS (SELECT source_url, model_id, min(id) AS id FROM posts WHERE source = 'twitter' GROUP BY ALL), n AS (SELECT source_url, model_id, min(id) AS id FROM posts WHERE source <> 'twitter' GROUP BY ALL) SELECT * FROM s UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source_url = n.source_url AND s.model_id = n.model_id)"),
    "conditional_upsert": with_posts("SELECT id, CASE WHEN h THEN 'pending' ELSE status END AS status, CASE WHEN h THEN greatest(attempts, 3) ELSE attempts END AS attempts, CASE WHEN h THEN least(coalesce(next_at, posted_at), posted_at) ELSE next_at END AS next_at, CASE WHEN h THEN coalesce(error, 'queued') ELSE error END AS error FROM (SELECT *, id % 4 = 1 AND status <> 'classified' AS h FROM posts)"),
    "merge_upsert": "SELECT month, priority, CASE WHEN month >= '1997-01' THEN n * 10 ELSE n END AS n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL)",
    "classify_posts": with_posts("SELECT sentiment, sentiment AS said, count(*) AS n FROM posts GROUP BY sentiment"),
}
