"""Queries over products accumulated from claims, in batch and as a stream, as-of scores, and incidents beside falls as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import asof, products, rumors, series
from pulsegrid.plans import rumors as claims_of
from pulsegrid.plans.claims import components_sql
from pulsegrid.plans.scores import ANOMALY_SQL, DAILY_SQL, daily
from pulsegrid.plans.streams import fresh
from pulsegrid.plans.views import models, pick, posts, read, with_posts
from pulsegrid.shared import write_table
from pulsegrid.streaming import incidents as incident_stream
from pulsegrid.streaming import posts as stream
from pulsegrid.streaming import products as product_stream

SAID = ["next week", "mid-July", "Mid July", "Q3 2026"]
#: Longer than the claims' span of years, so that none is late.
LATENESS = "5000 days"


def full_claims(li: DataFrame) -> DataFrame:
    """Claims with what they say of times, and their weight."""
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    more = li.where("l_linenumber = 1").select(
        o.alias("id"), F.concat(F.lit("claim "), o.cast("string")).alias("summary"), F.when(o % 7 < 3, pick(SAID, p % 4)).alias("eta_text"), F.when(o % 13 == 0, F.concat(F.lit("2026-07-0"), (p % 9 + 1).cast("string"))).alias("eta_date"),
        ((o % 10) / 10.0).alias("confidence"), ((o * 7) % 40).cast("int").alias("rank"), (o % 500).alias("reach"), *(c for c in li.columns),
    )
    return claims_of.claims_from(more, "summary", "eta_text", "eta_date", "confidence", "rank", "reach")


def product_accumulate(spark: SparkSession, folder: str) -> DataFrame:
    """Products with the leading claim, its expected time, conflicts and the best sources."""
    return listed(products.accumulate(rumors.clusters(full_claims(read(spark, folder, "lineitem"))), keep=4))


def listed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("platforms", F.concat_ws(",", "platforms")).withColumn("sources", F.concat_ws(",", "sources"))


PRODUCTS_SQL = f"""{claims_of.CLAIMS_SQL.replace('l_shipdate AS posted_at', "l_shipdate AS posted_at, 'claim ' || l_orderkey AS summary, CASE WHEN l_orderkey % 7 < 3 THEN " + str(SAID) + "[l_partkey % 4 + 1] END AS eta_text, CASE WHEN l_orderkey % 13 = 0 THEN '2026-07-0' || (l_partkey % 9 + 1) END AS eta_date, (l_orderkey % 10) / 10.0::DOUBLE AS confidence, (l_orderkey * 7) % 40 AS rank, l_orderkey % 500 AS reach").split(', fresh AS')[0].rpartition('fresh AS')[0]}
spoken AS (SELECT *, family || '|' || cluster_key AS scope_key, {claims_of.TOKENS_SQL} AS tokens, (rank, -list_position({rumors.PRECEDENCE}, claim_type), posted_at, confidence, id) AS ord,
  regexp_replace(lower(eta_text), '[^a-z0-9]', '', 'g') AS eta_key FROM clustered), {components_sql('spoken', 'scope_key', 'tokens', 'origin')},
rooted AS (SELECT s.*, o.root FROM spoken s JOIN origin o ON o.scope = s.scope_key AND o.n = s.tokens[1]),
lead AS (SELECT family, cluster_key, arg_max(claim_type, ord) AS claim_type, arg_max(summary, ord) AS claim_summary, count(DISTINCT eta_key) > 1 OR count(DISTINCT eta_date) > 1 AS eta_conflicting, count(DISTINCT root) AS mention_count,
  array_to_string(list_sort(list(DISTINCT platform)), ',') AS platforms, bool_or(credible) AS has_credible_source, min(posted_at) AS first_seen_at, max(posted_at) AS last_seen_at FROM rooted GROUP BY family, cluster_key),
timed AS (SELECT family, cluster_key, claim_type, max(struct_pack(ord := ord, t := eta_text, d := eta_date)) AS x FROM rooted WHERE eta_text IS NOT NULL OR eta_date IS NOT NULL GROUP BY ALL),
best AS (SELECT family, cluster_key, root, max((rank, posted_at, reach, url)) AS s FROM rooted GROUP BY ALL),
kept AS (SELECT family, cluster_key, string_agg(s[4], ',' ORDER BY s DESC, root) AS sources FROM (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY family, cluster_key ORDER BY s DESC, root) <= 4) GROUP BY ALL)
SELECT lead.*, x.t AS eta_text, x.d AS eta_date, sources FROM lead JOIN kept USING (family, cluster_key) LEFT JOIN timed USING (family, cluster_key, claim_type)"""


def stream_products(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a stream of claims; which names are one product is a table."""
    schema = read(spark, folder, "lineitem").schema
    names = claims_of.clustered(spark, folder).select("family", "label", "cluster_key").distinct()
    arriving = full_claims(stream.landed(spark, f"{folder}/lineite[m].parquet", schema)).join(names, ["family", "label"])
    changes = product_stream.accumulate(arriving, LATENESS, keep=4)
    return listed(product_stream.run_available(changes, fresh(spark, "stream-products")).drop("is_open"))


def prior_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Each post with its model's latest daily score strictly before it."""
    p = posts(spark, folder).select("id", "model_id", "posted_at")
    scores = daily(spark, folder).select("model_id", F.col("period_start").alias("scored_at"), "score")
    return asof.asof(p, scores, ["model_id"], "posted_at", "scored_at", ["score"])


def prior_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Each line item with its supplier's latest earlier or same-day order of any customer: hot keys over years, by slices of 90 days."""
    li = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("lane"), F.col("l_shipdate").cast("timestamp").alias("shipped_at"))
    o = read(spark, folder, "orders").select((F.col("o_custkey") % 4).alias("lane"), F.col("o_orderdate").cast("timestamp").alias("ordered_at"), "o_orderkey")
    return asof.asof(li, o, ["lane"], "shipped_at", "ordered_at", ["o_orderkey"], strict=False, width=90 * 86_400)


FAR = "2100-01-01"


def incident_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Incidents (days with bad posts) and falls of the daily score, by model."""
    p = posts(spark, folder).where("sentiment = 'negative'")
    days = p.groupBy(F.col("model_id").alias("model_slug"), F.date_trunc("day", "posted_at").alias("event_day")).agg(F.min("id").alias("event_id"))
    return days.select("event_id", "model_slug", "event_day"), incident_stream.falls_of(series.anomalies(daily(spark, folder)), F.col("model_id"))


def stream_incident_falls(spark: SparkSession, folder: str) -> DataFrame:
    """Incidents with falls within two days, both as streams; a closing row on either side lets the last incidents out."""
    left, right = incident_rows(spark, folder)
    closing = spark.createDataFrame([(-1, "", FAR)], "event_id long, model_slug string, d string")
    paths = [write_table(left, "incidents"), write_table(right, "falls")]
    place = fresh(spark, "stream-falls")

    def rows() -> DataFrame:
        sides = [stream.landed(spark, path, df.schema) for path, df in zip(paths, (left, right), strict=True)]
        return incident_stream.near_falls(*sides, days=2, lateness="400 days")

    incident_stream.run_available(rows(), place)
    closing.select("event_id", "model_slug", F.col("d").cast("timestamp").alias("event_day")).write.mode("append").parquet(paths[0])
    closing.select(F.col("model_slug").alias("fall_slug"), F.col("d").cast("timestamp").alias("fall_day"), F.lit(0.0).alias("z")).write.mode("append").parquet(paths[1])
    found = incident_stream.run_available(rows(), place).where("event_id >= 0")
    return found.select("event_id", "model_slug", F.col("event_day").cast("date").cast("string").alias("event_day"), F.col("fall_day").cast("date").cast("string").alias("fall_day"), F.round("z", 6).alias("z"))


FALLS_SQL = f"""{DAILY_SQL}{ANOMALY_SQL}, incidents AS (SELECT min(id) AS event_id, model_id AS model_slug, posted_at::DATE AS event_day FROM posts WHERE sentiment = 'negative' GROUP BY ALL)
SELECT event_id, model_slug, event_day::VARCHAR AS event_day, g.period_start::DATE::VARCHAR AS fall_day, round(g.z, 6) AS z
FROM incidents e LEFT JOIN graded g ON g.model_id = e.model_slug AND g.severity <> 'normal' AND g.z < 0 AND abs(date_diff('day', e.event_day, g.period_start::DATE)) <= 2"""

QUERIES = {
    "product_accumulate": product_accumulate,
    "stream_products": stream_products,
    "prior_scores": prior_scores,
    "prior_runs": prior_runs,
    "stream_incident_falls": stream_incident_falls,
}
ORACLE = {
    "product_accumulate": f"WITH RECURSIVE {PRODUCTS_SQL}",
    "stream_products": f"WITH RECURSIVE {PRODUCTS_SQL}",
    "prior_scores": with_posts(f"{DAILY_SQL} SELECT p.id, p.model_id, p.posted_at, s.score, s.period_start AS scored_at FROM posts p ASOF LEFT JOIN scores s ON p.model_id = s.model_id AND p.posted_at > s.period_start"),
    "prior_runs": "WITH o AS (SELECT o_custkey % 4 AS lane, o_orderdate AS ordered_at, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) SELECT l_orderkey, l_linenumber, l.l_suppkey % 3 AS lane, l_shipdate AS shipped_at, o.o_orderkey, o.ordered_at FROM lineitem l ASOF LEFT JOIN o ON l.l_suppkey % 3 = o.lane AND l.l_shipdate >= o.ordered_at",
    "stream_incident_falls": with_posts(FALLS_SQL),
}
