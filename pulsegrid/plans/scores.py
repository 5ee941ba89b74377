"""Score queries: daily and hourly scores, and what reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions.taxonomy import complaint_sql
from pulsegrid.operators import scoring, series
from pulsegrid.plans.views import NOW, ago, models, now, posts, with_posts

DAY_SQL = "date_trunc('day', posted_at - INTERVAL 8 HOUR) + INTERVAL 8 HOUR"
HOUR_SQL = "date_trunc('hour', posted_at)"
NOW_SQL = f"TIMESTAMP '{NOW}'"


def raw_sql(period: str, where: str = "true") -> str:
    """Tables up to ``rated``: raw scores with volumes and quality flags."""
    return f""", ranged AS (SELECT *, {period} AS period_start FROM posts WHERE {where}),
elig AS (SELECT *, CASE WHEN sentiment = 'negative' THEN {complaint_sql('complaint')} END AS category,
  least(greatest(confidence, 0.0::DOUBLE), 1.0::DOUBLE) * (CASE WHEN content_type = 'title_only' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END)
  * least(greatest(1.0::DOUBLE, ln(greatest(engagement, 0) + 1.0::DOUBLE)), ln(1001.0::DOUBLE)) AS w FROM ranged WHERE status = 'classified' AND confidence >= 0.65),
small AS (SELECT model_id, period_start, source, sentiment, category, sum(w) AS w, count(*) AS n FROM elig GROUP BY ALL),
sized AS (SELECT *, sum(w) OVER (PARTITION BY model_id, period_start, source) AS source_w, sum(w) OVER (PARTITION BY model_id, period_start) AS total FROM small),
large AS (SELECT *, max(source_w) OVER (PARTITION BY model_id, period_start) AS largest FROM sized),
capped AS (SELECT *, w * CASE WHEN source_w = largest AND total - largest > 0 AND largest > total * cap + 1e-9::DOUBLE THEN least(1.0::DOUBLE, (total - largest) * cap / ((1 - cap) * largest)) ELSE 1.0::DOUBLE END AS cw
  FROM (SELECT *, CASE WHEN total - largest >= 3 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE + 0.5::DOUBLE * (1 - (total - largest) / 3) END AS cap FROM large) c),
tops AS (SELECT model_id, period_start, category FROM (SELECT model_id, period_start, category, row_number() OVER (PARTITION BY model_id, period_start ORDER BY round(sum(cw), 9) DESC, category) AS r
  FROM capped WHERE category IS NOT NULL GROUP BY model_id, period_start, category) t WHERE r = 1),
scored AS (SELECT model_id, period_start, sum(CASE WHEN sentiment = 'positive' THEN n ELSE 0 END)::BIGINT AS positive_count, sum(CASE WHEN sentiment = 'negative' THEN n ELSE 0 END)::BIGINT AS negative_count,
  sum(CASE WHEN sentiment = 'neutral' THEN n ELSE 0 END)::BIGINT AS neutral_count, sum(n)::BIGINT AS eligible_posts,
  CASE WHEN sum(cw) > 0 THEN floor(round(100 * (sum(CASE WHEN sentiment = 'positive' THEN cw ELSE 0 END) + 0.5::DOUBLE * sum(CASE WHEN sentiment = 'neutral' THEN cw ELSE 0 END)) / sum(cw), 9) + 0.5::DOUBLE)::INTEGER ELSE 50 END AS raw_score
  FROM capped GROUP BY model_id, period_start),
vol AS (SELECT model_id, period_start, count(*) FILTER (WHERE status = 'classified') AS classified, count(*) FILTER (WHERE status IN ('pending', 'retry')) AS queued_posts, count(*) FILTER (WHERE status = 'failed') AS failed_posts FROM ranged GROUP BY ALL),
shares AS (SELECT s.*, t.category AS top_complaint, v.classified, v.queued_posts, v.failed_posts, v.classified + v.queued_posts + v.failed_posts AS total_posts,
  CASE WHEN v.classified + v.queued_posts > 0 THEN v.classified / (v.classified + v.queued_posts)::DOUBLE ELSE 1.0::DOUBLE END AS classification_coverage,
  CASE WHEN v.classified + v.queued_posts + v.failed_posts > 0 THEN v.failed_posts / (v.classified + v.queued_posts + v.failed_posts)::DOUBLE ELSE 0.0::DOUBLE END AS failed_share
  FROM scored s JOIN vol v USING (model_id, period_start) LEFT JOIN tops t USING (model_id, period_start)),
based AS (SELECT *, CASE WHEN queued_posts > 5 OR classification_coverage < 0.85 OR failed_share > 0.15 THEN 'partial_coverage' WHEN eligible_posts < 5 THEN 'thin_sample' ELSE 'measured' END AS score_basis_status FROM shares),
rated AS (SELECT *, CASE WHEN eligible_posts >= 10 AND classification_coverage >= 0.85 AND score_basis_status = 'measured' THEN 'high' WHEN eligible_posts >= 5 AND classification_coverage >= 0.65 THEN 'medium' ELSE 'low' END AS score_confidence FROM based)"""


DAILY_SQL = (
    raw_sql(DAY_SQL)
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY period_start) AS r,
  CASE WHEN eligible_posts <= 1 THEN 0.2::DOUBLE WHEN eligible_posts <= 3 THEN 0.3::DOUBLE WHEN eligible_posts < 5 THEN 0.4::DOUBLE WHEN eligible_posts >= 10 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE + (eligible_posts - 4) / 6.0::DOUBLE * 0.3::DOUBLE END AS sw FROM rated),
folded AS (SELECT model_id, r, raw_score AS score FROM numbered WHERE r = 1
  UNION ALL SELECT n.model_id, n.r, floor(round(n.sw * n.raw_score + (1 - n.sw) * f.score, 9) + 0.5::DOUBLE)::INTEGER FROM folded f JOIN numbered n ON n.model_id = f.model_id AND n.r = f.r + 1),
scores AS (SELECT n.model_id, n.period_start, n.raw_score, f.score, n.positive_count, n.negative_count, n.neutral_count, n.eligible_posts, n.top_complaint, n.queued_posts, n.failed_posts, n.total_posts,
  n.classification_coverage, n.score_basis_status, n.score_confidence, n.queued_posts + n.failed_posts AS unclassified_posts FROM numbered n JOIN folded f USING (model_id, r))"""
)


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.daily(posts(spark, folder))


def score_daily(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder).withColumn("classification_coverage", F.round("classification_coverage", 6))


def score_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Scores stored a week ago, without the posts that came in since, brought up to date: the same as scoring all posts at once."""
    p = posts(spark, folder)
    stored = scoring.daily(p.where(F.col("posted_at") < ago(days=6)))
    return scoring.recompute(stored, p, now()).withColumn("classification_coverage", F.round("classification_coverage", 6))


def score_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.hourly(posts(spark, folder), ago(days=2)).withColumn("classification_coverage", F.round("classification_coverage", 6))


def source_share_cap(spark: SparkSession, folder: str) -> DataFrame:
    parts = scoring.cells(posts(spark, folder), scoring.day_start(F.col("posted_at")))
    return parts.where("sentiment is not null").groupBy("model_id", "period_start", "source").agg(F.round(F.sum("w"), 6).alias("weight"), F.round(F.sum("capped"), 6).alias("capped_weight"))


def top_complaint_weighted(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder).where("top_complaint is not null").select("model_id", "period_start", "top_complaint")


def landing_scores(spark: SparkSession, folder: str) -> DataFrame:
    """One row a model: latest and previous score, recent volumes, queue."""
    all_posts, recent = posts(spark, folder), F.col("posted_at") > ago(days=7)
    # a day's score is computed five minutes after the day
    ranked = daily(spark, folder).where(F.col("period_start") > ago(days=90)).withColumn("score_computed_at", F.col("period_start") + F.expr("interval 1445 minutes"))
    ranked = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("period_start"))))
    of = lambda c, rn, name: F.max(F.when(F.col("rn") == rn, F.col(c))).alias(name)
    same = ("eligible_posts", "top_complaint", "score_basis_status", "score_confidence", "queued_posts", "unclassified_posts", "failed_posts", "classification_coverage", "score_computed_at")
    last = ranked.where("rn <= 2").groupBy("model_id").agg(
        of("score", 1, "latest_score"), of("score", 2, "previous_score"), of("period_start", 1, "score_period_start"), of("total_posts", 1, "latest_score_total_posts"), *(of(c, 1, c) for c in same)
    )
    relevant = F.col("status") != "irrelevant"
    week = all_posts.where(recent).groupBy("model_id").agg(
        F.count_if(relevant).alias("total_posts"), F.max(F.when(relevant, F.col("posted_at"))).alias("latest_post_posted_at"), F.max(F.when(relevant, F.col("created_at"))).alias("latest_post_ingested_at"),
        F.count_if(F.col("status").isin("pending", "retry")).alias("pending_classifications"), F.count_if(F.col("status") == "failed").alias("failed_classifications"),
    )
    out = models(spark).join(last, "model_id", "left").join(week, "model_id", "left")
    today = scoring.day_start(now())
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "model_id", F.col("name").alias("model_name"), F.col("slug").alias("model_slug"), "accent_color", F.coalesce("latest_score", F.lit(50)).alias("latest_score"), "previous_score",
        zero("total_posts"), "top_complaint", zero("eligible_posts"), "score_period_start", (F.col("score_period_start") + F.expr("interval 1 day")).alias("score_period_end"), zero("latest_score_total_posts"),
        "latest_post_posted_at", "latest_post_ingested_at", F.coalesce("score_basis_status", F.lit("stale_no_current_score")).alias("score_basis_status"), F.coalesce("score_confidence", F.lit("low")).alias("score_confidence"),
        F.col("score_computed_at").alias("last_updated"), "score_computed_at", zero("eligible_posts").alias("latest_score_eligible_posts"), zero("total_posts").alias("recent_posts_7d"), F.col("score_period_start").alias("measurement_period_start"),
        F.lit(None).cast("timestamp").alias("carried_from_period_start"), F.col("score_period_start").alias("latest_measurement_period_start"), zero("queued_posts"), zero("unclassified_posts"), zero("failed_posts"), F.round(F.coalesce("classification_coverage", F.lit(1.0)), 6).alias("classification_coverage"),
        (F.col("score_period_start").isNull() | (F.col("score_period_start") < today)).alias("is_stale"), zero("pending_classifications"), zero("failed_classifications"),
    )


LANDING_SQL = f"""{DAILY_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY period_start DESC) AS rn FROM scores WHERE period_start > {NOW_SQL} - INTERVAL 90 DAY),
week AS (SELECT model_id, count(*) AS total_posts, max(posted_at) AS latest_post_posted_at, max(created_at) AS latest_post_ingested_at FROM posts WHERE posted_at > {NOW_SQL} - INTERVAL 7 DAY AND status <> 'irrelevant' GROUP BY ALL),
waiting AS (SELECT model_id, count(*) FILTER (WHERE status IN ('pending', 'retry')) AS p, count(*) FILTER (WHERE status = 'failed') AS f FROM posts WHERE posted_at > {NOW_SQL} - INTERVAL 7 DAY GROUP BY ALL)
SELECT m.model_id, m.name AS model_name, m.slug AS model_slug, m.accent_color, coalesce(a.score, 50) AS latest_score, b.score AS previous_score, coalesce(w.total_posts, 0) AS total_posts, a.top_complaint, coalesce(a.eligible_posts, 0) AS eligible_posts,
 a.period_start AS score_period_start, a.period_start + INTERVAL 1 DAY AS score_period_end, coalesce(a.total_posts, 0) AS latest_score_total_posts, w.latest_post_posted_at, w.latest_post_ingested_at,
 coalesce(a.score_basis_status, 'stale_no_current_score') AS score_basis_status, coalesce(a.score_confidence, 'low') AS score_confidence,
 a.period_start + INTERVAL 1445 MINUTE AS last_updated, a.period_start + INTERVAL 1445 MINUTE AS score_computed_at, coalesce(a.eligible_posts, 0) AS latest_score_eligible_posts, coalesce(w.total_posts, 0) AS recent_posts_7d, a.period_start AS measurement_period_start, NULL::TIMESTAMP AS carried_from_period_start, a.period_start AS latest_measurement_period_start,
 coalesce(a.queued_posts, 0) AS queued_posts, coalesce(a.unclassified_posts, 0) AS unclassified_posts, coalesce(a.failed_posts, 0) AS failed_posts, round(coalesce(a.classification_coverage, 1.0::DOUBLE), 6) AS classification_coverage,
 a.period_start IS NULL OR a.period_start < date_trunc('day', {NOW_SQL} - INTERVAL 8 HOUR) + INTERVAL 8 HOUR AS is_stale, coalesce(q.p, 0) AS pending_classifications, coalesce(q.f, 0) AS failed_classifications
FROM models m LEFT JOIN ranked a ON a.model_id = m.model_id AND a.rn = 1 LEFT JOIN ranked b ON b.model_id = m.model_id AND b.rn = 2 LEFT JOIN week w ON w.model_id = m.model_id LEFT JOIN waiting q ON q.model_id = m.model_id"""


def score_sparkline(spark: SparkSession, folder: str) -> DataFrame:
    """Each model's last seven scores among those of so many days, at least two and at most ninety."""
    days = max(2, series.clamp(400, 30, 90))
    return series.latest(daily(spark, folder).where(F.col("period_start") > ago(days=days)), ["model_id"], "period_start", 7).select("model_id", "period_start", "score")


def score_trend(spark: SparkSession, folder: str) -> DataFrame:
    return series.trend(daily(spark, folder)).select("model_id", "period_start", "score", "change", "direction")


def score_history(spark: SparkSession, folder: str) -> DataFrame:
    rows = series.between(daily(spark, folder).where(F.col("model_id") == "m1"), "period_start", until="2024-01-25")
    return rows.orderBy(F.desc("period_start")).limit(series.clamp(500, 30, 240)).select("model_id", "period_start", "score", "total_posts")


def model_by_slug(spark: SparkSession, folder: str) -> DataFrame:
    """The model of a slug, if any post is filed under it."""
    return models(spark).where(F.col("slug") == "gemini").join(posts(spark, folder).select("model_id"), "model_id", "left_semi")


def score_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    found = series.anomalies(daily(spark, folder))
    return found.select("model_id", "period_start", "score", F.round("baseline_mean", 6).alias("baseline_mean"), F.round("baseline_stddev", 6).alias("baseline_stddev"), F.round("z", 6).alias("z"), "severity")


ANOMALY_SQL = """, based2 AS (SELECT *, CASE WHEN score_basis_status = 'measured' AND total_posts > 0 AND eligible_posts >= 5 THEN score END AS base FROM scores),
wide AS (SELECT *, count(base) OVER w AS bn, avg(base) OVER w AS bm, stddev_samp(base) OVER w AS bs FROM based2
  WINDOW w AS (PARTITION BY model_id ORDER BY period_start RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING)),
anomalies AS (SELECT model_id, period_start, score, bm AS baseline_mean, greatest(coalesce(bs, 0), 1.0::DOUBLE) AS baseline_stddev, (score - bm) / greatest(coalesce(bs, 0), 1.0::DOUBLE) AS z FROM wide
  WHERE bn >= 3 AND score_basis_status = 'measured' AND eligible_posts >= 5 AND classification_coverage >= 0.8),
graded AS (SELECT *, CASE WHEN abs(z) >= 3 THEN 'breach' WHEN abs(z) >= 2 THEN 'watch' ELSE 'normal' END AS severity FROM anomalies)"""


def status_anomaly_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Each model's incidents (days with many errors) with the falls of its score within two days."""
    p = posts(spark, folder)
    events = p.where("sentiment = 'negative'").groupBy("model_id", F.to_date("posted_at").alias("event_date")).agg(F.count(F.lit(1)).alias("n_errors"))
    found = series.anomalies(daily(spark, folder)).where("severity <> 'normal' and z < 0")
    met = series.within_days(events, found.select("model_id", F.to_date("period_start").alias("day"), F.date_format("period_start", "yyyy-MM-dd").alias("label")), 2)
    return met.withColumn("event_date", F.col("event_date").cast("string"))


CORRELATION_SQL = f"""{DAILY_SQL}{ANOMALY_SQL}, incidents AS (SELECT model_id, posted_at::DATE AS event_date, count(*) AS n_errors FROM posts WHERE sentiment = 'negative' GROUP BY ALL)
SELECT e.model_id, e.event_date::VARCHAR AS event_date, e.n_errors, coalesce(string_agg(strftime(g.period_start, '%Y-%m-%d'), ',' ORDER BY g.period_start), '') AS matches
FROM incidents e LEFT JOIN graded g ON g.model_id = e.model_id AND g.severity <> 'normal' AND g.z < 0 AND abs(date_diff('day', e.event_date, g.period_start::DATE)) <= 2 GROUP BY e.model_id, e.event_date, e.n_errors"""


def daily_chart_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Ten days of each model, with gaps as nulls, and whether a day's score was only carried forward."""
    basis = F.when(F.dayofmonth("period_start") % 5 == 0, "carried_forward").otherwise(F.col("score_basis_status"))
    scored = daily(spark, folder).where("eligible_posts >= 5").select("model_id", F.to_date(F.from_utc_timestamp("period_start", scoring.ZONE)).alias("day"), "score", "eligible_posts", basis.alias("score_basis_status"), "total_posts")
    made = series.grid(models(spark).select("model_id"), scored, "2024-01-30", 10)
    return made.select("model_id", F.col("day").cast("string").alias("day"), "score", "eligible_posts", "score_basis_status", series.carried(F.col("score_basis_status"), F.col("total_posts")).alias("is_carry_forward"))


def score_backfill_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Stored scores against a recomputation that lacks a source."""
    p = posts(spark, folder)
    old = scoring.daily(p.where("source <> 'reddit'")).select("model_id", "period_start", "score")
    return series.difference(old, scoring.daily(p).select("model_id", "period_start", "score"), ["model_id", "period_start"], "score")


DIFF_SQL = "SELECT model_id, period_start, o.score AS old_score, n.score AS new_score, n.score - o.score AS delta FROM ({old}) o FULL JOIN ({new}) n USING (model_id, period_start) WHERE o.score IS DISTINCT FROM n.score"


def dedup_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Of the posts under one (source_url, model) key, the one created last."""
    return series.latest(posts(spark, folder), ["source_url", "model_id"], "created_at", 1, "id").select("source_url", "model_id", "id")


def as_of_seed(spark: SparkSession, folder: str) -> DataFrame:
    """The latest daily score strictly before an instant."""
    before = daily(spark, folder).where(F.col("period_start") < F.lit("2024-01-20").cast("timestamp"))
    return before.groupBy("model_id").agg(F.max_by("score", "period_start").alias("seed_score"), F.max("period_start").alias("seed_period_start"))


def compare_pair(spark: SparkSession, folder: str) -> DataFrame:
    """The two models with the best latest scores."""
    last = series.latest(daily(spark, folder), ["model_id"], "period_start", 1)
    return last.orderBy(F.desc("score"), "model_id").limit(2).select("model_id", "score")


def chart_domain(spark: SparkSession, folder: str) -> DataFrame:
    return series.y_domain(daily(spark, folder))


_S = f"{DAILY_SQL} SELECT "
_ROUND = "* REPLACE (round(classification_coverage, 6) AS classification_coverage)"
QUERIES = {
    "score_daily": score_daily,
    "score_incremental": score_incremental,
    "score_hourly": score_hourly,
    "source_share_cap": source_share_cap,
    "top_complaint_weighted": top_complaint_weighted,
    "landing_scores": landing_scores,
    "score_sparkline": score_sparkline,
    "score_trend": score_trend,
    "score_history": score_history,
    "model_by_slug": model_by_slug,
    "score_anomalies_zscore": score_anomalies,
    "status_anomaly_correlation": status_anomaly_correlation,
    "daily_chart_grid": daily_chart_grid,
    "score_backfill_diff": score_backfill_diff,
    "dedup_scores": dedup_scores,
    "as_of_seed": as_of_seed,
    "compare_pair": compare_pair,
    "chart_domain": chart_domain,
}
_OLD = with_posts(DAILY_SQL.replace("FROM posts WHERE true", "FROM posts WHERE source <> 'reddit'") + " SELECT model_id, period_start, score FROM scores")
ORACLE = {
    "score_daily": with_posts(_S + _ROUND + " FROM scores"),
    "score_incremental": with_posts(_S + _ROUND + " FROM scores"),
    "score_hourly": with_posts(raw_sql(HOUR_SQL, f"posted_at >= {NOW_SQL} - INTERVAL 2 DAY") + " SELECT * EXCLUDE (raw_score, classified, failed_share) REPLACE (round(classification_coverage, 6) AS classification_coverage), raw_score AS score FROM rated"),
    "source_share_cap": with_posts(raw_sql(DAY_SQL) + " SELECT model_id, period_start, source, round(sum(w), 6) AS weight, round(sum(cw), 6) AS capped_weight FROM capped GROUP BY ALL"),
    "top_complaint_weighted": with_posts(_S + "model_id, period_start, top_complaint FROM scores WHERE top_complaint IS NOT NULL"),
    "landing_scores": with_posts(LANDING_SQL),
    "score_sparkline": with_posts(_S + "model_id, period_start, score FROM scores QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY period_start DESC) <= 7"),
    "score_trend": with_posts(_S + "model_id, period_start, score, score - lag(score) OVER w AS change, CASE WHEN score > lag(score) OVER w THEN 'up' WHEN score < lag(score) OVER w THEN 'down' ELSE 'flat' END AS direction FROM scores WINDOW w AS (PARTITION BY model_id ORDER BY period_start)"),
    "score_history": with_posts(_S + "model_id, period_start, score, total_posts FROM scores WHERE model_id = 'm1' AND period_start <= TIMESTAMP '2024-01-25' ORDER BY period_start DESC LIMIT 240"),
    "model_by_slug": with_posts("SELECT model_id, slug, name, accent_color FROM models WHERE slug = 'gemini' AND model_id IN (SELECT model_id FROM posts)"),
    "score_anomalies_zscore": with_posts(f"{DAILY_SQL}{ANOMALY_SQL} SELECT model_id, period_start, score, round(baseline_mean, 6) AS baseline_mean, round(baseline_stddev, 6) AS baseline_stddev, round(z, 6) AS z, severity FROM graded"),
    "status_anomaly_correlation": with_posts(CORRELATION_SQL),
    "daily_chart_grid": with_posts(f"{DAILY_SQL} SELECT m.model_id, d.day::DATE::VARCHAR AS day, s.score, s.eligible_posts, s.basis AS score_basis_status, coalesce(s.basis = 'carried_forward' OR s.total_posts = 0, false) AS is_carry_forward FROM models m CROSS JOIN generate_series(DATE '2024-01-21', DATE '2024-01-30', INTERVAL 1 DAY) d(day) LEFT JOIN (SELECT *, CASE WHEN day(period_start) % 5 = 0 THEN 'carried_forward' ELSE score_basis_status END AS basis FROM scores) s ON s.model_id = m.model_id AND s.eligible_posts >= 5 AND (s.period_start - INTERVAL 8 HOUR)::DATE = d.day::DATE"),
    "score_backfill_diff": DIFF_SQL.format(old=_OLD, new=with_posts(_S + "model_id, period_start, score FROM scores")),
    "dedup_scores": with_posts("SELECT source_url, model_id, id FROM posts QUALIFY row_number() OVER (PARTITION BY source_url, model_id ORDER BY created_at DESC, id DESC) = 1"),
    "as_of_seed": with_posts(_S + "model_id, arg_max(score, period_start) AS seed_score, max(period_start) AS seed_period_start FROM scores WHERE period_start < TIMESTAMP '2024-01-20' GROUP BY model_id"),
    "compare_pair": with_posts(_S + "model_id, score FROM (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY period_start DESC) = 1) ORDER BY score DESC, model_id LIMIT 2"),
    "chart_domain": with_posts(f"{DAILY_SQL}, b AS (SELECT model_id, greatest(0, floor((min(score) - 5) / 5.0) * 5)::INTEGER AS lo, least(100, ceil((max(score) + 5) / 5.0) * 5)::INTEGER AS hi FROM scores GROUP BY model_id) SELECT model_id, CASE WHEN hi - lo < 30 THEN greatest(0, lo - (30 - (hi - lo)) // 2) ELSE lo END::INTEGER AS y_min, CASE WHEN hi - lo < 30 THEN least(100, greatest(0, lo - (30 - (hi - lo)) // 2) + 30) ELSE hi END::INTEGER AS y_max FROM b"),
}
