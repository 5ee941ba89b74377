"""Queries over runs' records, classifier results, vendors' events, and tables written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.taxonomy import PRAISES, complaint_sql
from pulsegrid.operators import events, results, runs, scoring, upserts
from pulsegrid.plans import texts
from pulsegrid.plans.scores import DAILY_SQL
from pulsegrid.plans.views import NOW, ago, models, now, pick, posts, read, with_posts
from pulsegrid.shared import tables_dir, write_table

N = f"TIMESTAMP '{NOW}'"
TIMES = ["08:00", "14:30", "20:00", "23:00"]
SAID = ["quota exceeded", "could not classify", "timeout"]


def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Runs' counters and status from summaries made of orders."""
    o = read(spark, folder, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    some = lambda name, value, when: F.when(when, value).alias(name)
    errors = F.when(k % 4 == 0, F.array(pick(SAID, c % 3))).when(k % 4 == 1, F.array().cast("array<string>"))
    summary = F.to_json(F.struct(some("posts_found", (c % 5).cast("int"), k % 3 == 0), some("fetched", (c % 7).cast("int"), k % 3 == 1), some("classified", (c % 3).cast("int"), k % 2 == 0), some("inserted", (c % 4).cast("int"), k % 5 == 0), some("filtered", (c % 6).cast("int"), k % 2 == 0), some("classificationQueued", (c % 2).cast("int"), k % 7 < 3), some("skipped", F.lit(True), k % 19 == 0), some("status", F.lit("failed"), k % 23 == 0), errors.alias("errors")))
    return runs.metrics(o.select(k.alias("id"), summary.alias("summary"))).drop("summary")


METRICS_SQL = f"""WITH s AS (SELECT o_orderkey AS id, o_orderkey AS k, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 5 END, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey % 7 END, 0)::INTEGER AS posts_found,
  coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 3 END, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 4 END, 0)::INTEGER AS posts_classified, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 6 ELSE 0 END::INTEGER AS filtered_candidates,
  CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 4 ELSE 0 END::INTEGER AS net_new_rows, CASE WHEN o_orderkey % 7 < 3 THEN o_custkey % 2 ELSE 0 END::INTEGER AS classification_queued, 0 AS duplicate_conflicts,
  CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS n_errors, o_orderkey % 4 = 0 AND o_custkey % 3 < 2 AS stuck FROM orders)
SELECT id, CASE WHEN k % 19 = 0 THEN 'skipped' WHEN k % 23 = 0 THEN 'failed' WHEN filtered_candidates > 0 AND posts_classified = 0 AND stuck THEN CASE WHEN classification_queued > 0 THEN 'partial' ELSE 'failed' END
  WHEN n_errors > 0 THEN CASE WHEN posts_found > 0 OR posts_classified > 0 OR net_new_rows > 0 THEN 'partial' ELSE 'failed' END ELSE 'success' END AS run_status, * EXCLUDE (id, k, stuck) FROM s"""


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches of run records appended to one log and read back."""
    path = write_table(run_metrics(spark, folder).where("id % 2 = 0"), "run-log")
    runs.append(run_metrics(spark, folder).where("id % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("run_status").agg(F.count(F.lit(1)).alias("n"), F.sum("posts_found").alias("posts_found"))


def scrape_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Posts by the collectors' daily window in which they were written."""
    label = runs.window_label(F.col("posted_at"), scoring.ZONE, TIMES, 90)
    return posts(spark, folder).groupBy(label.alias("window"), "source").agg(F.count(F.lit(1)).alias("n"))


def budget_check(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as planned charges against a month's and a day's spending."""
    o = read(spark, folder, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    reason = runs.budget(F.when(k % 11 != 0, price / 1000), F.when(k % 3 != 0, (k % 100) / 10.0), (k % 37) / 4.0 - 1, 200.0, 12.0)
    return o.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Posts with a classifier's answers as JSON, some of the wrong form."""
    p, i = posts(spark, folder), F.col("id")
    said = F.to_json(F.struct(F.when(i % 13 != 0, i % 4 != 0).alias("relevant"), F.when(i % 17 == 0, "angry").otherwise(F.col("sentiment")).alias("sentiment"), F.when(i % 19 != 0, (i % 120) / 100.0).alias("confidence"), F.coalesce("complaint", F.lit("none")).alias("complaint_category"), F.coalesce("praise", F.lit("none")).alias("praise_category")))
    return p.select("id", F.when(i % 29 == 0, "[1]").when(i % 31 == 0, "no json").otherwise(said).alias("said"))


def result_validation(spark: SparkSession, folder: str) -> DataFrame:
    return results.validated(answers(spark, folder)).drop("said")


_PRAISE = f"CASE WHEN praise IN ({', '.join(repr(p) for p in PRAISES)}) THEN praise END"
VALIDATION_SQL = f""", a AS (SELECT *, CASE WHEN id % 29 = 0 OR id % 31 = 0 THEN 'result_not_object' WHEN id % 13 = 0 THEN 'missing_relevant_boolean' WHEN id % 4 <> 0 AND id % 17 = 0 THEN 'missing_or_invalid_sentiment' WHEN id % 4 <> 0 AND id % 19 = 0 THEN 'missing_confidence' END AS err FROM posts),
f AS (SELECT *, err IS NULL AND id % 4 <> 0 AS fine FROM a)
SELECT id, CASE WHEN err IS NULL THEN id % 4 <> 0 END AS relevant, CASE WHEN fine THEN sentiment END AS sentiment, CASE WHEN fine AND sentiment = 'negative' THEN coalesce({complaint_sql('complaint')}, 'other') END AS complaint_category,
  CASE WHEN fine AND sentiment = 'positive' THEN {_PRAISE} END AS praise_category, CASE WHEN fine THEN least(1.0::DOUBLE, (id % 120) / 100.0::DOUBLE) WHEN err IS NULL THEN 0.0::DOUBLE END AS confidence,
  CASE WHEN err IS NOT NULL THEN 'parse_error' WHEN fine THEN 'classified' ELSE 'irrelevant' END AS status, err AS error FROM f"""


def result_zip(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of seven posts beside answers that lack the last ones of every third batch."""
    p = posts(spark, folder).select("id", F.floor(F.col("id") / 7).alias("batch"), (F.col("id") % 7).cast("int").alias("place"))
    short = F.when(F.col("batch") % 3 == 0, 5).otherwise(7)
    said = p.where(F.col("place") < short).groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: F.concat(F.lit("r"), x["id"])).alias("results"))
    return results.zipped(p, said, "batch", "place").select("id", "said", "result_error")


def mention_texts(spark: SparkSession, folder: str) -> DataFrame:
    """What a classifier reads of documents, some of them posted in a community."""
    d, i = read(spark, folder, "documents"), F.col("doc_id")
    said = results.mention_text(F.concat(F.lit(" Title \t"), i), results.sanitised(F.col("text")), F.when(i % 3 == 0, F.concat(F.lit("https://www.Reddit.com/r/sub"), i % 5, F.lit("/x"))))
    return d.select("doc_id", F.length(said).cast("long").alias("n_chars"), F.md5(said).alias("text_md5"))


_LINE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_TEXT = _LINE.format("regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')")
MENTION_SQL = f"""SELECT doc_id, length(m) AS n_chars, md5(m) AS text_md5 FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '(posted in r/sub' || (doc_id % 5) || ') ' ELSE '' END || {_LINE.format(f"('Title ' || doc_id || ' ' || substring({_TEXT}, 1, 3500))")} AS m FROM documents)"""


def vendor_event_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Vendors' events, made of the first orders of days, on the days for which a model has a score."""
    o = read(spark, folder, "orders").where("o_orderkey < 400")
    k = F.col("o_orderkey")
    begin = F.date_add(F.lit("2023-12-20").cast("date"), (k % 60).cast("int"))
    made = o.select(F.concat(F.lit("v"), k % 3).alias("vendor"), F.when(k % 5 == 0, pick(["claude", "chatgpt", "gemini", "grok"], k % 4)).alias("model_slug"), F.concat(F.lit("event "), k).alias("title"), begin.alias("start"), F.when(k % 2 == 0, F.date_add(begin, (k % 9).cast("int"))).alias("end")).distinct()
    known = models(spark).select("slug", "model_id", F.concat(F.lit("v"), F.col("model_id").substr(2, 1).cast("int") % 3).alias("vendor"))
    p = posts(spark, folder).where("k < 60 and day(posted_at) % 4 <> 0")
    days = p.join(F.broadcast(known), "model_id").select("slug", F.to_date("posted_at").alias("day")).distinct()
    found = events.markers(days, events.of_models(known.select("slug", "vendor"), made))
    return found.withColumn("from_day", F.col("from_day").cast("string")).withColumn("to_day", F.col("to_day").cast("string"))


EVENTS_SQL = """, e AS (SELECT DISTINCT 'v' || (o_orderkey % 3) AS vendor, CASE WHEN o_orderkey % 5 = 0 THEN (['claude', 'chatgpt', 'gemini', 'grok'])[o_orderkey % 4 + 1] END AS model_slug, 'event ' || o_orderkey AS title, DATE '2023-12-20' + (o_orderkey % 60)::INTEGER AS s,
  CASE WHEN o_orderkey % 2 = 0 THEN DATE '2023-12-20' + (o_orderkey % 60)::INTEGER + (o_orderkey % 9)::INTEGER END AS e FROM orders WHERE o_orderkey < 400),
m AS (SELECT slug, model_id, 'v' || (model_id[2]::INTEGER % 3) AS vendor FROM models), d AS (SELECT DISTINCT slug, posted_at::DATE AS day FROM posts JOIN m USING (model_id) WHERE k < 60 AND day(posted_at) % 4 <> 0),
sp AS (SELECT slug, min(day) AS f, max(day) AS l FROM d GROUP BY slug), j AS (SELECT m.slug, title, s, coalesce(e.e, s) AS e FROM m JOIN e ON e.model_slug = m.slug OR (e.model_slug IS NULL AND e.vendor = m.vendor)),
g AS (SELECT j.slug, title, min(day) FILTER (WHERE day >= greatest(s, f)) AS a, max(day) FILTER (WHERE day <= least(e, l)) AS b FROM j JOIN sp USING (slug) JOIN d ON d.slug = j.slug WHERE e >= f AND s <= l GROUP BY j.slug, title, s, e)
SELECT slug, title, a::VARCHAR AS from_day, CASE WHEN a <> b THEN b::VARCHAR END AS to_day FROM g WHERE a IS NOT NULL AND b IS NOT NULL"""


def score_replace_range(spark: SparkSession, folder: str) -> DataFrame:
    """A table of daily scores by day, of which a week is wrong, with a day that has lost its posts, and then replaced, read back."""
    scored = scoring.daily(posts(spark, folder)).select("model_id", "period_start", "score", F.to_date("period_start").cast("string").alias("day"))
    late = F.col("period_start") >= ago(days=7)
    gone = F.to_date(ago(days=3)).cast("string")
    path = f"{tables_dir(spark)}/scores-by-day-{uuid.uuid4().hex}"
    scored.withColumn("score", F.when(late, -1).otherwise(F.col("score"))).write.partitionBy("day").parquet(path)
    upserts.replace_range(path, scored.where(late & (F.col("day") != gone)), "day", "2024-01-24", "2024-01-31")
    return spark.read.schema("model_id string, period_start timestamp, score int, day string").parquet(path).select("model_id", "period_start", "score")


def surface_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The surface dataset, with commas and quotes in its names, as CSV and back."""
    rows = texts.surface_dataset(spark, folder).withColumn("surface", F.concat(F.lit('"'), "surface", F.lit('", x')))
    path = f"{tables_dir(spark)}/surface-csv-{uuid.uuid4().hex}"
    upserts.export_csv(rows, path)
    return spark.read.option("header", True).option("escape", '"').schema(rows.schema).csv(path).withColumn("top_complaint", F.coalesce("top_complaint", F.lit("")))


def checked_markers(spark: SparkSession, folder: str) -> DataFrame:
    p = posts(spark, folder).select("id", "source_url", F.when(F.col("id") % 10 == 0, F.col("created_at")).alias("checked_at"))
    return upserts.checked(p, p.where("id % 7 = 0"), now()).select("id", "checked_at")


def low_information_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions attributed to one model that only speak of local models are deleted; what stays."""
    said = F.lower("text")
    named = texts.mentions(spark, folder).withColumn("slug", F.when(F.col("id") % 2 == 1, "chatgpt").otherwise("claude"))
    gone = (F.col("slug") == "chatgpt") & said.rlike(r"(gpt[: -]?oss|oss[- ]?(20b|120b)|self-?hosted|local llm|home lab|ollama|lm studio|huggingface\.co/openai/gpt-oss)") & ~said.rlike(r"(chat ?gpt|gpt[- ]4o|gpt[- ]5(\.4)?|o4(-mini)?)")
    return named.where(~gone).select("id", "slug")


def named_values(spark: SparkSession, folder: str) -> DataFrame:
    """Surfaces from an array and from a JSON array of objects, each once."""
    p, i = posts(spark, folder), F.col("id")
    document = F.to_json(F.array(F.to_json(F.struct((i % 3).cast("string").alias("name"))), F.to_json(F.struct((i % 5).cast("string").alias("name"))), F.lit("{}")))
    rows = p.select("id", F.when(i % 4 != 0, F.array((i % 2).cast("string"), (i % 7).cast("string"))).alias("a"), document.alias("d"))
    return upserts.named_values(rows, ["id"], "a", "d", "$.name").select("id", F.concat_ws(",", "found").alias("found"))


def score_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Scores in words, and how long ago their day was."""
    hours = F.floor((F.unix_timestamp(now()) - F.unix_timestamp("period_start")) / 3600)
    ago_ = F.when(hours < 1, "just now").when(hours < 24, F.concat(hours, F.lit("h ago"))).otherwise(F.concat(F.floor(hours / 24), F.lit("d ago")))
    return scoring.daily(posts(spark, folder)).select("model_id", "period_start", scoring.vibe_label(F.col("score")).alias("label"), ago_.alias("age"))


QUERIES = {
    "run_metrics": run_metrics,
    "run_log": run_log,
    "scrape_windows": scrape_windows,
    "budget_check": budget_check,
    "result_validation": result_validation,
    "result_zip": result_zip,
    "mention_texts": mention_texts,
    "vendor_event_markers": vendor_event_markers,
    "score_replace_range": score_replace_range,
    "surface_csv": surface_csv,
    "checked_markers": checked_markers,
    "low_information_cleanup": low_information_cleanup,
    "named_values": named_values,
    "score_labels": score_labels,
}
_MINUTE = "(hour(posted_at - INTERVAL 8 HOUR) * 60 + minute(posted_at - INTERVAL 8 HOUR))"
_WINDOWS = "CASE " + " ".join(f"WHEN {_MINUTE} BETWEEN {int(t[:2]) * 60 + int(t[3:])} AND {int(t[:2]) * 60 + int(t[3:]) + 90} THEN '{n}'" for t, n in zip(TIMES, ["morning", "afternoon", "evening", "window_4"], strict=True)) + " END"
ORACLE = {
    "run_metrics": METRICS_SQL,
    "run_log": f"SELECT run_status, count(*) AS n, sum(posts_found) AS posts_found FROM ({METRICS_SQL}) GROUP BY run_status",
    "scrape_windows": with_posts(f"SELECT {_WINDOWS} AS \"window\", source, count(*) AS n FROM posts GROUP BY ALL"),
    "budget_check": "SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'budget unreadable' WHEN o_totalprice::DOUBLE / 1000 + c > 200 THEN 'monthly budget exceeded' WHEN o_orderkey % 3 <> 0 AND (o_orderkey % 100) / 10.0::DOUBLE + c > 12 THEN 'daily budget exceeded' END AS reason, count(*) AS n FROM (SELECT *, greatest((o_orderkey % 37) / 4.0::DOUBLE - 1, 0) AS c FROM orders) GROUP BY ALL",
    "result_validation": with_posts(VALIDATION_SQL),
    "result_zip": with_posts("SELECT id, CASE WHEN NOT m THEN 'r' || id END AS said, CASE WHEN m THEN 'missing_result_index' END AS result_error FROM (SELECT id, (id // 7) % 3 = 0 AND id % 7 >= 5 AS m FROM posts)"),
    "mention_texts": MENTION_SQL,
    "vendor_event_markers": with_posts(EVENTS_SQL),
    "score_replace_range": with_posts(f"{DAILY_SQL} SELECT model_id, period_start, score FROM scores WHERE period_start::DATE <> DATE '2024-01-28'"),
    "surface_csv": texts.ORACLE["surface_dataset"].replace("SELECT n.*,", "SELECT n.* REPLACE ('\"' || n.surface || '\", x' AS surface),"),
    "checked_markers": with_posts(f", u AS (SELECT DISTINCT source_url FROM posts WHERE id % 7 = 0) SELECT id, CASE WHEN id % 10 = 0 THEN created_at WHEN u.source_url IS NOT NULL THEN {N} END AS checked_at FROM posts LEFT JOIN u USING (source_url)"),
    "low_information_cleanup": f"WITH {texts.MENTIONS_SQL} SELECT id, slug FROM (SELECT id, lower(text) AS t, CASE WHEN id % 2 = 1 THEN 'chatgpt' ELSE 'claude' END AS slug FROM mentions) WHERE NOT (slug = 'chatgpt' AND regexp_matches(t, '(gpt[: -]?oss|oss[- ]?(20b|120b)|self-?hosted|local llm|home lab|ollama|lm studio|huggingface\\.co/openai/gpt-oss)') AND NOT regexp_matches(t, '(chat ?gpt|gpt[- ]4o|gpt[- ]5(\\.4)?|o4(-mini)?)'))",
    "named_values": with_posts("SELECT id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN id % 4 <> 0 THEN [(id % 2)::VARCHAR, (id % 7)::VARCHAR] ELSE [] END, [(id % 3)::VARCHAR, (id % 5)::VARCHAR]))), ',') AS found FROM posts"),
    "score_labels": with_posts(f"{DAILY_SQL} SELECT model_id, period_start, CASE WHEN score <= 40 THEN 'negative' WHEN score <= 65 THEN 'mixed' ELSE 'positive' END AS label, CASE WHEN h < 1 THEN 'just now' WHEN h < 24 THEN h || 'h ago' ELSE (h // 24) || 'd ago' END AS age FROM (SELECT *, floor(epoch({N} - period_start) / 3600)::BIGINT AS h FROM scores)"),
}
