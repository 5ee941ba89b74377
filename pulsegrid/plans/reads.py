"""Read queries: chatter pages, breakdowns, trends, monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import taxonomy
from pulsegrid.functions.taxonomy import complaint_sql
from pulsegrid.operators import breakdowns, monitor, queue, scoring, series
from pulsegrid.plans.views import ERRORS_SQL, NOW, RUNS_SQL, ago, errors, models, now, posts, read, runs, with_posts

N = f"TIMESTAMP '{NOW}'"


def recent_chatter_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = posts(spark, folder).where("status = 'classified'").join(F.broadcast(models(spark)), "model_id")
    return series.page(rows, "posted_at", "id", ("2024-01-20 00:00:00", 5000), series.clamp(80, 20, 50)).select("id", "slug", "source", "sentiment", "posted_at")


def model_posts(spark: SparkSession, folder: str) -> DataFrame:
    rows = posts(spark, folder).where((F.col("model_id") == "m0") & (F.col("posted_at") >= ago(days=10)))
    return series.page(rows, "posted_at", "id", None, series.clamp(None, 100, 200)).select("id", "source", "posted_at", "sentiment")


def complaint_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    rows = posts(spark, folder).where(F.col("posted_at") > ago(days=30))
    found = breakdowns.with_pct(breakdowns.breakdown(rows, taxonomy.complaint(F.col("complaint")), "category"), ["model_id"])
    return found.withColumn("label", taxonomy.complaint_label(F.col("category")))


def source_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return breakdowns.with_pct(breakdowns.breakdown(posts(spark, folder).where(F.col("posted_at") > ago(days=30)), F.col("source"), "source"), ["model_id"])


def trending(spark: SparkSession, folder: str) -> DataFrame:
    return breakdowns.week_over_week(posts(spark, folder), taxonomy.complaint(F.col("complaint")), now())


def trending_complaints(spark: SparkSession, folder: str) -> DataFrame:
    return trending(spark, folder).join(F.broadcast(models(spark).select("model_id", "slug")), "model_id")


TREND_SQL = f""", c AS (SELECT model_id, {complaint_sql('complaint')} AS category, posted_at FROM posts WHERE status = 'classified'),
t AS (SELECT model_id, category, count(*) FILTER (WHERE posted_at >= {N} - INTERVAL 7 DAY) AS this_week, count(*) FILTER (WHERE posted_at < {N} - INTERVAL 7 DAY) AS last_week FROM c WHERE category IS NOT NULL AND posted_at >= {N} - INTERVAL 14 DAY GROUP BY model_id, category),
u AS (SELECT *, sum(this_week) OVER (PARTITION BY model_id) AS total FROM t WHERE this_week > 3),
trending AS (SELECT model_id, category, this_week, last_week, CASE WHEN last_week = 0 THEN 100 ELSE round(100.0::DOUBLE * (this_week - last_week) / last_week) END::INTEGER AS pct_change FROM u WHERE total > 5)"""


def top_mover(spark: SparkSession, folder: str) -> DataFrame:
    """For each model the category that changed most."""
    best = F.min(F.struct((-F.abs("pct_change")).alias("o"), "category", "pct_change"))
    return trending(spark, folder).groupBy("model_id").agg(best.alias("x")).select("model_id", "x.category", "x.pct_change")


def sentiment_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Sentiments of each model's latest 25 posts of the week."""
    rows = posts(spark, folder).where((F.col("posted_at") >= ago(days=7)) & (F.col("status") == "classified"))
    return breakdowns.with_pct(series.latest(rows, ["model_id"], "posted_at", 25, "id").groupBy("model_id", "sentiment").agg(F.count(F.lit(1)).alias("n")), ["model_id"])


def recent_errors(spark: SparkSession, folder: str) -> DataFrame:
    return monitor.recent_errors(errors(spark, folder), now(), series.clamp(500, 24, 168))


def critical_alerts(spark: SparkSession, folder: str) -> DataFrame:
    rows = errors(spark, folder).where((F.col("severity") == "critical") & (F.col("created_at") > ago(hours=168)))
    return rows.orderBy(F.desc("created_at"), "id").limit(20).select("id", "function_name", monitor.redacted(F.col("context")).alias("context"), "created_at")


def monitor_runs(spark: SparkSession, folder: str) -> DataFrame:
    return monitor.latest_runs(runs(spark, folder), series.clamp(900, 100, 200))


def mixed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs, some of which succeeded in part."""
    part = (F.col("status") == "success") & (F.col("id") % 6 == 0)
    return runs(spark, folder).withColumn("status", F.when(part, "partial").otherwise(F.col("status")))


def monitor_summary(spark: SparkSession, folder: str) -> DataFrame:
    return monitor.summary(mixed_runs(spark, folder))


#: How many hours each source may go without a run; of one there never is any.
STALE_HOURS = [("hackernews", 11), ("bluesky", 11), ("mastodon", 2), ("twitter", 14), ("reddit", 27), ("appstore", 11)]


def health_alerts(spark: SparkSession, folder: str) -> DataFrame:
    last = F.lit("1998-08-02 12:00:00").cast("timestamp")
    p = posts(spark, folder)
    # a day's score is computed when the day is over
    computed = p.where("status = 'classified' and confidence >= 0.65").agg((F.max(scoring.day_start(F.col("posted_at"))) + F.expr("interval 1 day")).alias("score_computed_at"))
    return monitor.alerts(queue.exact_health(p, ago(days=2)), mixed_runs(spark, folder), spark.createDataFrame(STALE_HOURS, "source string, hours int"), computed, last, now(), backlog=30, failed=40, recent_failed=1)


ALERTS_SQL = f""", {RUNS_SQL}, mixed AS (SELECT * REPLACE (CASE WHEN status = 'success' AND id % 6 = 0 THEN 'partial' ELSE status END AS status) FROM runs),
h AS (SELECT count(*) FILTER (WHERE status IN ('pending', 'retry')) AS w, count(*) FILTER (WHERE status = 'failed') AS f, count(*) FILTER (WHERE status = 'failed' AND posted_at >= {N} - INTERVAL 3 DAY) AS r, floor(epoch({N} - min(created_at) FILTER (WHERE status IN ('pending', 'retry'))) / 60 + 0.5) AS a FROM posts),
lag AS (SELECT floor(epoch({N} - (max(period_start) + INTERVAL 1 DAY)) / 60 + 0.5) AS l FROM (SELECT date_trunc('day', posted_at - INTERVAL 8 HOUR) + INTERVAL 8 HOUR AS period_start FROM posts WHERE status = 'classified' AND confidence >= 0.65)),
s AS (SELECT source, max(started_at) AS last_run, max(started_at) FILTER (WHERE status IN ('success', 'partial')) AS last_ok FROM mixed WHERE started_at BETWEEN TIMESTAMP '1998-08-02 12:00:00' - INTERVAL 72 HOUR AND TIMESTAMP '1998-08-02 12:00:00' GROUP BY source),
j AS (SELECT l.source, hours, floor(epoch(TIMESTAMP '1998-08-02 12:00:00' - last_run) / 3600 + 0.5) AS a, floor(epoch(TIMESTAMP '1998-08-02 12:00:00' - last_ok) / 3600 + 0.5) AS o FROM (VALUES {', '.join(map(str, STALE_HOURS))}) l(source, hours) LEFT JOIN s USING (source))
SELECT 'queue_backlog' AS alert, '' AS subject, w::BIGINT AS amount FROM h WHERE w >= 30 UNION ALL SELECT 'queue_age', '', a::BIGINT FROM h WHERE a >= 60 UNION ALL SELECT 'failed_total', '', f::BIGINT FROM h WHERE f >= 40 UNION ALL SELECT 'failed_recently', '', r::BIGINT FROM h WHERE r >= 1
UNION ALL SELECT 'aggregation_lag', '', l::BIGINT FROM lag WHERE l IS NULL OR l >= 90
UNION ALL SELECT CASE WHEN a IS NULL OR a >= hours THEN 'source_stale' ELSE 'source_no_success' END, source, CASE WHEN a IS NULL OR a >= hours THEN a ELSE o END::BIGINT FROM j WHERE a IS NULL OR a >= hours OR o IS NULL OR o >= 30"""


def staleness(spark: SparkSession, folder: str) -> DataFrame:
    """The model whose newest post was ingested longest ago, and whether that is three hours or more."""
    newest = posts(spark, folder).groupBy("model_id").agg(F.max("created_at").alias("newest"))
    return newest.agg(F.min("newest").alias("oldest_ingest")).withColumn("is_stale", F.col("oldest_ingest") <= ago(hours=3))


def share_of_chatter(spark: SparkSession, folder: str) -> DataFrame:
    """Each model's share of a Pacific day's posts, and those that speak of purchases."""
    rows = posts(spark, folder).groupBy(scoring.day_start(F.col("posted_at")).alias("period_start"), "model_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("title").rlike("purchase")).alias("mention_posts"))


    return rows.withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("period_start")), 6))


def chatter_collapse(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each post with the models it was filed under: for each URL, or without one for each source and beginning of the text."""
    url = F.when(F.col("id") % 4 != 0, F.col("source_url")).when(F.col("id") % 8 == 0, "")
    rows = posts(spark, folder).withColumn("source_url", url).join(F.broadcast(models(spark).select("model_id", "slug")), "model_id")
    key = breakdowns.post_key(F.col("source_url"), F.col("source"), F.lit(None).cast("string"), F.lit(""), F.col("title"))
    return rows.groupBy(key.alias("post_key")).agg(F.concat_ws(",", F.array_sort(F.collect_set("slug"))).alias("models"), F.max("posted_at").alias("posted_at"), F.count(F.lit(1)).alias("n"))


def audit_windows(spark: SparkSession, folder: str) -> DataFrame:
    return breakdowns.audit(posts(spark, folder), [7, 14, 21], now())


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    return breakdowns.stratified(posts(spark, folder).where("status = 'classified'"), ["model_id", "sentiment"], 5, "id").select("id", "model_id", "sentiment")


def votes(spark: SparkSession, folder: str) -> DataFrame:
    """Three made-up classifiers' votes on posts."""
    p = posts(spark, folder).where("status = 'classified'")
    pick = lambda n: F.when(F.col("id") % n == 0, "neutral").otherwise(F.col("sentiment"))
    voters = F.array(*(F.struct(F.lit(name).alias("voter"), pick(n).alias("vote")) for name, n in (("first", 10**9), ("second", 5), ("third", 3))))
    return p.select("id", F.explode(voters).alias("v")).select("id", "v.voter", "v.vote")


def agreement_rates(spark: SparkSession, folder: str) -> DataFrame:
    p = posts(spark, folder).where("status = 'classified'").select("id", "sentiment", "complaint", "praise")
    other = p.select("id", F.when(F.col("id") % 5 == 0, "neutral").otherwise(F.col("sentiment")).alias("sentiment"), F.when(F.col("id") % 4 == 0, "speed").otherwise(F.col("complaint")).alias("complaint"), F.when(F.col("id") % 3 != 0, F.col("praise")).alias("praise"))
    return breakdowns.agreement(p, other, "id", ["sentiment", "complaint", "praise"])


def pairwise_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return breakdowns.agreement_matrix(votes(spark, folder), "id", "voter", "vote")


def usage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select(F.col("l_returnflag").alias("tier"), F.col("l_quantity").alias("tokens"), F.floor(F.col("l_quantity") / 2).cast("double").alias("cached"))
    return breakdowns.usage(rows, "tier", "tokens", 0.001, "cached")


def config_multimap(spark: SparkSession, folder: str) -> DataFrame:
    """Key-value rows as one list for each key."""
    rows = read(spark, folder, "nation").join(read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("key")).agg(F.concat_ws(",", F.array_sort(F.collect_list("n_name"))).alias("values"))


def range_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = posts(spark, folder).where((F.col("posted_at") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("posted_at") < F.lit("2024-01-12").cast("timestamp")))
    return rows.select("id", "posted_at", "status")


def title_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of the last day whose title wasn't seen under the same model in the two days before."""
    p = posts(spark, folder).withColumn("title_key", F.concat("model_id", F.lit(":"), F.lower(F.substring("title", 1, 80))))
    seen = p.where((F.col("posted_at") >= ago(days=10)) & (F.col("posted_at") < ago(days=8))).select("title_key")
    new = p.where((F.col("posted_at") >= ago(days=8)) & (F.col("posted_at") < ago(days=7)))
    return new.join(seen, "title_key", "left_anti").select("id", "title_key")


def source_cap(spark: SparkSession, folder: str) -> DataFrame:
    """At most 15 rows of each source and day."""
    return series.latest(posts(spark, folder).withColumn("day", F.date_format("posted_at", "yyyy-MM-dd")), ["source", "day"], "posted_at", 15, "id").select("source", "day", "id")


def tumbling_hours(spark: SparkSession, folder: str) -> DataFrame:
    w = posts(spark, folder).groupBy(F.window("posted_at", "1 hour").alias("w"), "source").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("hour"), "source", "n")


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users: runs of events with gaps under half an hour."""
    e = read(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("started_at"), "n")


QUERIES = {
    "recent_chatter_page": recent_chatter_page,
    "model_posts": model_posts,
    "complaint_breakdown": complaint_breakdown,
    "source_breakdown": source_breakdown,
    "trending_complaints": trending_complaints,
    "top_mover_per_model": top_mover,
    "sentiment_mix": sentiment_mix,
    "recent_errors": recent_errors,
    "critical_alerts": critical_alerts,
    "scraper_monitor_runs": monitor_runs,
    "monitor_summary": monitor_summary,
    "health_alerts": health_alerts,
    "staleness": staleness,
    "share_of_chatter": share_of_chatter,
    "chatter_fanout_collapse": chatter_collapse,
    "audit_windows": audit_windows,
    "stratified_sample": stratified_sample,
    "agreement_rates": agreement_rates,
    "pairwise_agreement": pairwise_agreement,
    "usage_rollup": usage_rollup,
    "config_multimap": config_multimap,
    "range_scan": range_scan,
    "title_dedup": title_dedup,
    "source_cap_per_day": source_cap,
    "tumbling_hours": tumbling_hours,
    "user_sessions": user_sessions,
}
_PCT = "floor(round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY model_id), 9) + 0.5::DOUBLE)::INTEGER AS pct"
_LABEL = "CASE category WHEN 'pricing_value' THEN 'Pricing / value' WHEN 'api_reliability' THEN 'API reliability' ELSE upper(category[1]) || replace(category[2:], '_', ' ') END AS label"
_RED = "CASE WHEN context IS NULL THEN 'unknown' WHEN length(context) <= 80 AND context NOT LIKE '{%' THEN context ELSE 'redacted' END"
_VOTES = ", v AS (SELECT id, unnest(['first', 'second', 'third']) AS voter, unnest([sentiment, CASE WHEN id % 5 = 0 THEN 'neutral' ELSE sentiment END, CASE WHEN id % 3 = 0 THEN 'neutral' ELSE sentiment END]) AS vote FROM posts WHERE status = 'classified')"
ORACLE = {
    "recent_chatter_page": with_posts("SELECT id, slug, source, sentiment, posted_at FROM posts JOIN models USING (model_id) WHERE status = 'classified' AND (posted_at < TIMESTAMP '2024-01-20' OR (posted_at = TIMESTAMP '2024-01-20' AND id < 5000)) ORDER BY posted_at DESC, id DESC LIMIT 50"),
    "model_posts": with_posts(f"SELECT id, source, posted_at, sentiment FROM posts WHERE model_id = 'm0' AND posted_at >= {N} - INTERVAL 10 DAY ORDER BY posted_at DESC, id DESC LIMIT 100"),
    "complaint_breakdown": with_posts(f"SELECT model_id, category, n, {_PCT}, {_LABEL} FROM (SELECT model_id, {complaint_sql('complaint')} AS category, count(*) AS n FROM posts WHERE status = 'classified' AND posted_at > {N} - INTERVAL 30 DAY GROUP BY 1, 2) WHERE category IS NOT NULL"),
    "source_breakdown": with_posts(f"SELECT model_id, source, n, {_PCT} FROM (SELECT model_id, source, count(*) AS n FROM posts WHERE status = 'classified' AND posted_at > {N} - INTERVAL 30 DAY GROUP BY ALL)"),
    "trending_complaints": with_posts(f"{TREND_SQL} SELECT t.*, slug FROM trending t JOIN models USING (model_id)"),
    "top_mover_per_model": with_posts(f"{TREND_SQL} SELECT model_id, category, pct_change FROM trending QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY abs(pct_change) DESC, category) = 1"),
    "sentiment_mix": with_posts(f"SELECT model_id, sentiment, n, {_PCT} FROM (SELECT model_id, sentiment, count(*) AS n FROM (SELECT * FROM posts WHERE status = 'classified' AND posted_at >= {N} - INTERVAL 7 DAY QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY posted_at DESC, id DESC) <= 25) GROUP BY ALL)"),
    "recent_errors": f"WITH {ERRORS_SQL} SELECT function_name, {_RED} AS context, count(*) AS error_count, max(created_at) AS last_seen FROM errors WHERE created_at > {N} - INTERVAL 168 HOUR AND error_message IS NOT NULL AND error_message <> 'Function started' AND error_message NOT LIKE 'Successfully aggregated%' GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 50",
    "critical_alerts": f"WITH {ERRORS_SQL} SELECT id, function_name, {_RED} AS context, created_at FROM errors WHERE severity = 'critical' AND created_at > {N} - INTERVAL 168 HOUR ORDER BY created_at DESC, id LIMIT 20",
    "scraper_monitor_runs": f"WITH {RUNS_SQL} SELECT id, source, status, coalesce(posts_found, 0) AS posts_found, coalesce(net_new_rows, 0) AS net_new_rows, classification_queued::BIGINT AS classification_queued, date_diff('second', started_at, completed_at)::DOUBLE AS duration_seconds, started_at FROM runs ORDER BY started_at DESC, id LIMIT 200",
    "monitor_summary": f"WITH {RUNS_SQL}, mixed AS (SELECT * REPLACE (CASE WHEN status = 'success' AND id % 6 = 0 THEN 'partial' ELSE status END AS status) FROM runs) SELECT source, count(*) AS n_runs, {', '.join(f"count(*) FILTER (WHERE status = '{x}') AS n_{x}" for x in ('success', 'partial', 'failed', 'running'))}, arg_max(status, (started_at, id)) AS last_status, sum(classification_queued)::BIGINT AS classification_queued, coalesce(sum(deferred), 0)::BIGINT AS deferred, max(started_at) FILTER (WHERE status IN ('success', 'partial')) AS last_healthy_at FROM mixed GROUP BY source",
    "health_alerts": with_posts(ALERTS_SQL),
    "staleness": with_posts(f"SELECT min(m) AS oldest_ingest, min(m) <= {N} - INTERVAL 3 HOUR AS is_stale FROM (SELECT max(created_at) AS m FROM posts GROUP BY model_id)"),
    "share_of_chatter": with_posts("SELECT period_start, model_id, n, mention_posts, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY period_start), 6) AS share_pct FROM (SELECT date_trunc('day', posted_at - INTERVAL 8 HOUR) + INTERVAL 8 HOUR AS period_start, model_id, count(*) AS n, count(*) FILTER (WHERE title LIKE '%purchase%') AS mention_posts FROM posts GROUP BY ALL)"),
    "chatter_fanout_collapse": with_posts("SELECT CASE WHEN id % 4 <> 0 THEN source_url ELSE source || '::' || title[1:200] END AS post_key, string_agg(DISTINCT slug, ',' ORDER BY slug) AS models, max(posted_at) AS posted_at, count(*) AS n FROM posts JOIN models USING (model_id) GROUP BY post_key"),
    "audit_windows": with_posts(f"SELECT days, source, sentiment, count(*) AS n, count(*) FILTER (WHERE confidence < 0.65) AS low_confidence, count(*) FILTER (WHERE sentiment = 'negative' AND complaint IS NULL) AS uncategorised FROM posts, (VALUES (7), (14), (21)) d(days) WHERE posted_at >= {N} - to_days(days) GROUP BY GROUPING SETS ((days, source), (days, sentiment), (days))"),
    "stratified_sample": with_posts("SELECT id, model_id, sentiment FROM posts WHERE status = 'classified' QUALIFY row_number() OVER (PARTITION BY model_id, sentiment ORDER BY md5(id::VARCHAR), id) <= 5"),
    "agreement_rates": with_posts("SELECT count(*) AS n, round(avg((a_s IS NOT DISTINCT FROM sentiment)::INTEGER::DOUBLE), 3) AS sentiment_rate, round(avg((a_c IS NOT DISTINCT FROM complaint)::INTEGER::DOUBLE), 3) AS complaint_rate, round(avg((a_p IS NOT DISTINCT FROM praise)::INTEGER::DOUBLE), 3) AS praise_rate FROM (SELECT *, CASE WHEN id % 5 = 0 THEN 'neutral' ELSE sentiment END AS a_s, CASE WHEN id % 4 = 0 THEN 'speed' ELSE complaint END AS a_c, CASE WHEN id % 3 <> 0 THEN praise END AS a_p FROM posts WHERE status = 'classified')"),
    "pairwise_agreement": with_posts(f"{_VOTES} SELECT x.voter AS a, y.voter AS b, count(*) AS n, round(avg((x.vote = y.vote)::INTEGER::DOUBLE), 3) AS rate FROM v x JOIN v y ON x.id = y.id AND x.voter < y.voter GROUP BY ALL"),
    "usage_rollup": "SELECT tier, count(*) AS n, sum(tokens) AS total, round(median(tokens), 6) AS median, list_sort(list(tokens))[least(floor(count(*) * 0.95::DOUBLE), count(*) - 1)::BIGINT + 1] AS p95, round((sum(tokens - cached) + sum(cached) * 0.1::DOUBLE) * 0.001::DOUBLE, 6) AS cost FROM (SELECT l_returnflag AS tier, l_quantity AS tokens, floor(l_quantity / 2) AS cached FROM lineitem) GROUP BY tier",
    "config_multimap": "SELECT r_name AS key, string_agg(n_name, ',' ORDER BY n_name) AS values FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "range_scan": with_posts("SELECT id, posted_at, status FROM posts WHERE posted_at >= TIMESTAMP '2024-01-10' AND posted_at < TIMESTAMP '2024-01-12'"),
    "title_dedup": with_posts(f", p AS (SELECT *, model_id || ':' || lower(left(title, 80)) AS title_key FROM posts) SELECT id, title_key FROM p WHERE posted_at >= {N} - INTERVAL 8 DAY AND posted_at < {N} - INTERVAL 7 DAY AND title_key NOT IN (SELECT title_key FROM p WHERE posted_at >= {N} - INTERVAL 10 DAY AND posted_at < {N} - INTERVAL 8 DAY)"),
    "source_cap_per_day": with_posts("SELECT source, strftime(posted_at, '%Y-%m-%d') AS day, id FROM posts QUALIFY row_number() OVER (PARTITION BY source, strftime(posted_at, '%Y-%m-%d') ORDER BY posted_at DESC, id DESC) <= 15"),
    "tumbling_hours": with_posts("SELECT date_trunc('hour', posted_at) AS hour, source, count(*) AS n FROM posts GROUP BY ALL"),
    "user_sessions": "SELECT user_id, min(ts) AS started_at, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s",
}
