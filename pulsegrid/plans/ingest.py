"""Queries over the way from landed pages to stored posts, quarantine, and attribution by a table of keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import ingest
from pulsegrid.operators.attribution import Keyword, attribute, keyword_table, models_of_sql
from pulsegrid.plans.landed import BASE_SQL, PAGE, base, land, said, struct
from pulsegrid.plans.texts import KEYWORDS, MENTIONS_SQL, mentions
from pulsegrid.plans.views import NOW, models, now, pick, read, with_posts
from pulsegrid.shared import write_text
from pulsegrid.sources import landed

NAMED = ["claude", "chat gpt 5", "gemini model and grok", "grok", "nothing known"]
PATH_KEYWORDS = [Keyword("claude", "claude"), Keyword("chatgpt", "gpt-5"), Keyword("gemini", "gemini", "ambiguous", ("google", "model")), Keyword("grok", "grok")]
N = f"TIMESTAMP '{NOW}'"


def wide_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """The fixed keywords, and as further ones each two neighbouring words of benchmark items, joined by a hyphen, ambiguous if a comma can stand beside them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.element_at("w", i), F.lit("-"), F.element_at("w", i + 1)))
    made = read(spark, folder, "benchmark").select(words.alias("w")).where(F.size("w") > 1).select(F.explode(pairs).alias("word")).distinct()
    slug, unsure = F.concat(F.lit("s"), F.length("word") % 7), F.length("word") % 3 == 0
    made = made.select(slug.alias("slug"), "word", F.when(unsure, "ambiguous").otherwise("high").alias("tier"), F.when(unsure, "enen,ouou").alias("context"))
    return keyword_table(spark, KEYWORDS).unionByName(made)


def attribution_table(spark: SparkSession, folder: str) -> DataFrame:
    """Texts by thousands of keywords from a table, and by the community in which some were said."""
    said_in = mentions(spark, folder).withColumn("community", F.when(F.col("id") % 11 == 0, F.concat(F.lit("c"), F.col("id") % 4)))
    communities = spark.createDataFrame([("c0", "claude"), ("c1", "grok"), ("c2", "gemini")], "community string, slug string")
    return attribute(said_in, wide_keywords(spark, folder), community="community", communities=communities)


ATTRIBUTION_SQL = rf"""WITH {MENTIONS_SQL},
w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), pairs AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS word FROM w WHERE len(w) > 1),
kw AS (SELECT 's' || (length(word) % 7) AS slug, replace(word, ' ', '') AS letters, word, length(word) % 3 = 0 AS unsure FROM pairs),
low AS (SELECT id, lower(text) AS t, regexp_extract_all(lower(text), '([a-z0-9_]+)([^a-z0-9_]*)') AS p FROM mentions),
grams AS (SELECT DISTINCT id, regexp_replace(g, '[^a-z0-9_]+$', '') AS piece FROM (SELECT id, unnest(list_concat(p, list_transform(range(1, len(p)), lambda i: p[i] || p[i + 1]))) AS g FROM low)),
met AS (SELECT DISTINCT g.id, kw.slug, kw.unsure FROM grams g JOIN kw ON regexp_replace(g.piece, '[^a-z0-9_]', '', 'g') = kw.letters WHERE regexp_matches(g.piece, '^' || replace(kw.word, ' ', '[-\s.]?') || '$'))
SELECT id, slug FROM met WHERE NOT unsure UNION SELECT id, slug FROM met JOIN low USING (id) WHERE unsure AND (contains(t, 'enen') OR contains(t, 'ouou'))
UNION SELECT id, unnest({models_of_sql('text', KEYWORDS)}) FROM mentions UNION SELECT id, (['claude', 'grok', 'gemini'])[id % 4 + 1] FROM mentions WHERE id % 11 = 0 AND id % 4 < 3"""


def story_pages(spark: SparkSession, folder: str) -> str:
    """Pages of stories, some without an id or a time, and pages that broke off."""
    i = F.col("i")
    item = struct(objectID=F.when(i % 19 != 0, i.cast("string")), title=F.concat(F.lit("I tested "), pick(NAMED, i % 5), F.lit(" on job "), i % 300), story_text=F.when(i % 2 == 0, said("it went <b>well</b> {}", i)), points=F.col("n"), created_at=F.when(i % 17 == 0, "yesterday").otherwise(F.col("at")), author=F.concat(F.lit("a"), i % 9))
    rows = base(spark, folder)
    path = land(rows, item, "stories", "hits")
    broken = rows.where(i % PAGE == 7).select(F.concat(F.lit('{"hits": [{"objectID": "'), i))
    return f"{path.rpartition('/')[0]}/{{{path.rpartition('/')[2]},{write_text(broken, 'broken').rpartition('/')[2]}}}"


def quarantined_stories(spark: SparkSession, folder: str) -> DataFrame:
    """How many landed stories are put aside, and why."""
    return landed.quarantined(landed.stories(spark, story_pages(spark, folder))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def quarantined_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many items of four sources' pages are put aside, and why: some lack a URL or a time, some lines broke off."""
    i, rows = F.col("i"), base(spark, folder)
    url, at = F.when(i % 7 != 0, F.concat(F.lit("https://x/"), i)), F.when(i % 11 == 0, "soon").when(i % 13 != 0, F.col("at"))
    made = {
        "mastodon": (struct(url=url, created_at=at, content=F.lit("toot"), favourites_count=F.col("n")), None),
        "github": (struct(html_url=url, created_at=at, title=F.lit("it fails")), None),
        "appstore": (struct(app_id=F.lit("1"), id=struct(label=url), updated=struct(label=at)), None),
        "bluesky": (struct(uri=url, record=struct(text=F.lit("hi"), createdAt=at)), "posts"),
    }
    broken = write_text(rows.where(i % 9 == 0).select(F.concat(F.lit('{"url": '), i)), "broken").rpartition("/")
    found = []
    for source, (item, field) in made.items():
        path = land(rows.where(i % 2 == 0), item, source, field).rpartition("/")
        aside = landed.quarantine(spark, f"{path[0]}/{{{path[2]},{broken[2]}}}", source)
        found.append(aside.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(source).alias("source"), "reason", "n"))
    return reduce(DataFrame.unionByName, found)


def stored_rows(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("i")
    rows = base(spark, folder).where(i % 10 == 0)
    return rows.select(F.concat(F.lit("https://news.ycombinator.com/item?id="), i + i % 20).alias("source_url"), F.concat(F.lit("m"), i % 4).alias("model_id"), F.concat(F.lit("I tested "), pick(NAMED, i % 5), F.lit(" on JOB "), i % 300).alias("title"), F.col("posted_at"), F.lit("classified").alias("status"), F.lit(1).alias("attempts"), F.lit(None).cast("timestamp").alias("next_at"))


def ingest_path(spark: SparkSession, folder: str) -> DataFrame:
    """Landed pages to stored rows: read, put aside, kept or not, attributed, deduplicated, given their first state, inserted."""
    posts = landed.story_posts(landed.stories(spark, story_pages(spark, folder)))
    return ingest.stored_after(stored_rows(spark, folder), posts, keyword_table(spark, PATH_KEYWORDS), models(spark), now(), days=12).select("source_url", "model_id", "title", "status", "attempts", "next_at")


PATH_SQL = f""", {BASE_SQL}, names AS (SELECT *, 'I tested ' || ({str(NAMED)})[i % 5 + 1] || ' on job ' || (i % 300) AS title, 'https://news.ycombinator.com/item?id=' || i AS url FROM base),
stored AS (SELECT 'https://news.ycombinator.com/item?id=' || (i + i % 20) AS source_url, 'm' || (i % 4) AS model_id, replace(title, 'job', 'JOB') AS title, posted_at FROM names WHERE i % 10 = 0),
fresh AS (SELECT url AS source_url, m.model_id, title FROM names JOIN (VALUES (0, 'm0'), (1, 'm1'), (2, 'm2'), (2, 'm3'), (3, 'm3')) m(k, model_id) ON i % 5 = m.k WHERE i % 19 <> 0 AND i % 17 <> 0 AND url NOT IN (SELECT source_url FROM stored)),
known AS (SELECT DISTINCT model_id, lower(title[1:80]) AS t FROM stored WHERE posted_at >= {N} - INTERVAL 12 DAY),
new AS (SELECT f.*, bool_or(k.t IS NULL) OVER (PARTITION BY source_url) AS any_new FROM fresh f LEFT JOIN known k ON k.model_id = f.model_id AND k.t = lower(f.title[1:80]))
SELECT source_url, model_id, title, 'classified' AS status, 1 AS attempts, NULL::TIMESTAMP AS next_at FROM stored UNION ALL SELECT source_url, model_id, title, 'pending', 0, {N} FROM new WHERE any_new"""

QUERIES = {"attribution_table": attribution_table, "quarantined_stories": quarantined_stories, "quarantined_items": quarantined_items, "ingest_path": ingest_path}
ORACLE = {
    "attribution_table": ATTRIBUTION_SQL,
    "quarantined_stories": with_posts(f", {BASE_SQL} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN i % 19 = 0 THEN 'no_url' WHEN i % 17 = 0 THEN 'no_time' END AS reason FROM base, range(2) UNION ALL SELECT 'unreadable' FROM base WHERE i % {PAGE} = 7) WHERE reason IS NOT NULL GROUP BY reason"),
    "quarantined_items": with_posts(f", {BASE_SQL} SELECT source, reason, count(*) AS n FROM (SELECT CASE WHEN i % 7 = 0 THEN 'no_url' WHEN i % 11 = 0 OR i % 13 = 0 THEN 'no_time' END AS reason FROM base, range(2) WHERE i % 2 = 0 UNION ALL SELECT 'unreadable' FROM base WHERE i % 9 = 0), (VALUES ('mastodon'), ('github'), ('appstore'), ('bluesky')) s(source) WHERE reason IS NOT NULL GROUP BY ALL"),
    "ingest_path": with_posts(PATH_SQL),
}
