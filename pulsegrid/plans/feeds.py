"""Queries over comments that name a model, release feeds and model lists, compared pairs, prices, listed sources and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import taxonomy, text
from pulsegrid.operators import canon, ingest, leaderboard, monitor, products, queue
from pulsegrid.operators.attribution import keyword_table, models_of_sql
from pulsegrid.plans.ingest import PATH_KEYWORDS
from pulsegrid.plans.landed import BASE_SQL, base, feed, land, struct
from pulsegrid.plans.rumors import BOARD_SQL, board
from pulsegrid.plans.views import ERRORS_SQL, NOW, ago, errors, models, now, pick, posts, sql_list, with_posts
from pulsegrid.shared import write_text
from pulsegrid.sources import landed

N = f"TIMESTAMP '{NOW}'"
SAID = ["I used claude for this and it was fine {}", "we tested gpt 5 today, number {}", "no model is named in this long comment {}", "short {}", "Grok is now available to everyone, says number {}", "sponsored: the best claude prompts {}"]
ROOMS = ["ClaudeAI", "none", "grok"]


def comment_pages(spark: SparkSession, folder: str) -> str:
    i = F.col("i")
    said = F.replace(pick(SAID, i % len(SAID)), F.lit("{}"), i.cast("string"))
    item = struct(id=F.concat(F.lit("c"), i), dataType=F.when(i % 10 == 9, "post").otherwise("comment"), body=said, communityName=F.when(i % 4 != 3, pick(ROOMS, i % 3)), parsedCommunityName=F.when(i % 4 == 3, "grok"), upVotes=F.when(i % 3 == 0, F.col("n")), score=F.col("n"), createdAt=F.col("at"), commentUrl=F.when(i % 2 == 0, F.concat(F.lit("https://r/"), i, F.lit("/c"), i)), postUrl=F.concat(F.lit("https://r/p"), i % 7))
    return land(base(spark, folder), item, "comments")


def landed_comments_named(spark: SparkSession, folder: str) -> DataFrame:
    """The latest two hundred comments that name a model or stand in its community, with these models."""
    rooms = spark.createDataFrame([("ClaudeAI", "claude"), ("grok", "grok")], "community string, slug string")
    comments = landed.reddit_comments(spark, comment_pages(spark, folder), ago(days=20))
    return ingest.named(comments, keyword_table(spark, PATH_KEYWORDS), 200, rooms).select("source_url", "slug")


def _comments_sql() -> str:
    quoted = sql_list([s.replace("'", "''") for s in SAID])
    flags = text.flags_sql("body")
    return f""", {BASE_SQL}, c AS (SELECT i, tm, replace(({quoted})[i % {len(SAID)} + 1], '{{}}', i::VARCHAR) AS body, CASE WHEN i % 4 = 3 THEN 'grok' ELSE ({sql_list(ROOMS)})[i % 3 + 1] END AS room, CASE WHEN i % 2 = 0 THEN 'https://r/' || i || '/c' || i ELSE 'https://r/p' || (i % 7) || '#c' || i END AS source_url FROM base WHERE i % 10 <> 9 AND tm >= {N} - INTERVAL 20 DAY),
k AS (SELECT * FROM (SELECT *, {flags['long_enough']} AS l, ({flags['news']} OR {flags['promotion']} OR {flags['novelty']}) AS share, ({flags['rumor']} OR {flags['release']}) AS told FROM c WHERE length(body) >= 20) WHERE l AND (NOT share OR told)),
n AS (SELECT source_url, tm, unnest({models_of_sql('body', PATH_KEYWORDS)}) AS slug FROM k UNION SELECT source_url, tm, CASE room WHEN 'ClaudeAI' THEN 'claude' ELSE 'grok' END FROM k WHERE room <> 'none')
SELECT source_url, slug FROM n WHERE source_url IN (SELECT source_url FROM (SELECT DISTINCT source_url, tm FROM n) ORDER BY tm DESC, source_url LIMIT 200)"""


TITLES = ["Introducing GPT-{}.5", "GPT-{}.1 preview", "GPT-{} is generally available", "A talk"]
TELLS = ["It is available to everyone today", "early access for testing", "", "nothing new, released today"]


def released_from_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Versions that a vendor's feed of news says are released."""
    i = F.col("i")
    title = F.replace(pick(TITLES, i % 4), F.lit("{}"), (i % 13 + 6).cast("string"))
    item = F.concat(F.lit("<item><title><![CDATA["), title, F.lit("]]></title><description>"), pick(TELLS, F.floor(i / 4) % 4), F.lit("</description><link>https://v/"), i, F.lit("</link><category>"), F.when(i % 5 == 0, "Company").when(i % 5 == 1, "PRODUCT").otherwise("Product"), F.lit("</category></item>"))
    items = landed.release_items(spark, feed(base(spark, folder), item, "releases"))
    said = items.where(text.is_release(F.concat_ws(" ", "title", "description")))
    return said.select(F.explode(canon.announced_keys(spark, F.concat_ws(" ", "title", "description"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


RELEASED_SQL = f""", {BASE_SQL}, t AS (SELECT i, i % 13 + 6 AS v, i % 4 AS a, i // 4 % 4 AS b FROM base WHERE i % 5 <> 0)
SELECT CASE a WHEN 0 THEN 'gpt' || v || '5' WHEN 1 THEN 'gpt' || v || '1' ELSE 'gpt' || v END AS key, count(*) AS n FROM t WHERE a < 3 AND (a = 2 OR b IN (0, 3)) GROUP BY key"""


def listed_models(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that two vendors' lists of models hold."""
    i = F.col("i")
    rows = base(spark, folder)
    one = rows.where(i % 2 == 0).groupBy(F.floor(i / 50)).agg(F.collect_list(struct(id=F.concat(F.lit("gpt-"), i % 40, F.when(i % 3 == 0, "-20250101").otherwise("")))).alias("data")).select(F.to_json(F.struct("data")).alias("value"))
    two = rows.where(i % 2 == 1).groupBy(F.floor(i / 50)).agg(F.collect_list(struct(name=F.concat(F.lit("models/gemini-"), i % 30, F.lit("-pro")))).alias("models")).select(F.to_json(F.struct("models")).alias("value"))
    ids = landed.model_ids(spark, write_text(one.unionByName(two), "model-lists"))
    return ids.select("model_id", F.concat_ws(",", F.array_sort(canon.id_tokens(F.col("model_id")))).alias("tokens"))


MODELS_SQL = f""", {BASE_SQL}, ids AS (SELECT DISTINCT CASE WHEN i % 2 = 0 THEN 'gpt-' || (i % 40) || CASE WHEN i % 3 = 0 THEN '-20250101' ELSE '' END ELSE 'models/gemini-' || (i % 30) || '-pro' END AS model_id FROM base),
t AS (SELECT model_id, regexp_replace(regexp_replace(regexp_replace(model_id, '^models/', ''), '-20250101$', ''), '[^a-z0-9]', '', 'g') AS f FROM ids)
SELECT model_id, array_to_string(list_sort(list_filter([CASE WHEN length(f) >= 3 THEN f END, CASE WHEN starts_with(f, 'gpt') AND length(f) > 5 THEN f[4:] END, CASE WHEN starts_with(f, 'gemini') AND length(f) > 8 THEN f[7:] END], lambda x: x IS NOT NULL)), ',') AS tokens FROM t"""


def landed_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Compared pairs as a ledger holds them; each file is one array."""
    i = F.col("i")
    rows = base(spark, folder).groupBy(F.floor(i / 100)).agg(F.collect_list(struct(a=F.concat(F.lit("m"), i), b=F.when(i % 9 != 0, F.concat(F.lit("m"), i + 1)), delta=F.col("n") / 100, lo=F.col("n") / 200, holm_p=F.when(i % 2 == 0, 0.01), winner=F.when(i % 2 == 0, F.concat(F.lit("m"), i)))).alias("pairs"))
    return landed.pairwise(spark, write_text(rows.select(F.to_json("pairs").alias("value")), "pairs", 1))


def priced_lineup(spark: SparkSession, folder: str) -> DataFrame:
    """A board's models with today's prices, those of the test where they differ, and prices to come."""
    k = F.col("k")
    b = board(spark, folder)
    models_ = b.select("name", "score", F.when(k % 7 != 0, F.col("price")).alias("price_in"), F.when(k % 11 != 0, F.col("price") * 4).alias("price_out"))
    registry = b.where(k % 3 != 0).select("name", F.when(k % 5 != 0, F.col("price") + (k % 2)).alias("price_in"), (F.col("price") * 4).alias("price_out"), F.when(k % 4 == 0, F.col("price") * 2).alias("pending_in"), F.when(k % 8 == 0, F.col("price") * 8).alias("pending_out"), F.col("price_date").alias("effective"))
    return leaderboard.priced(models_, registry)


PRICED_SQL = f"""WITH {BOARD_SQL}, m AS (SELECT name, k, score, CASE WHEN k % 7 <> 0 THEN price END AS ti, CASE WHEN k % 11 <> 0 THEN price * 4 END AS tout, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN price + k % 2 END AS ri, CASE WHEN k % 3 <> 0 THEN price * 4 END AS ro, price, price_date FROM board),
c AS (SELECT *, coalesce(ri, ti, 0.0::DOUBLE) AS price_in, coalesce(ro, tout, 0.0::DOUBLE) AS price_out FROM m), f AS (SELECT *, ti IS NOT NULL AND tout IS NOT NULL AND (price_in <> ti OR price_out <> tout) AS changed FROM c)
SELECT name, round(score, 1) AS score, price_in, price_out, CASE WHEN changed THEN ti END AS at_test_in, CASE WHEN changed THEN tout END AS at_test_out, CASE WHEN k % 3 <> 0 AND k % 4 = 0 THEN price * 2 END AS pending_in, CASE WHEN k % 3 <> 0 AND k % 8 = 0 THEN price * 8 END AS pending_out, CASE WHEN k % 3 <> 0 AND k % 4 = 0 THEN price_date END AS effective FROM f"""


def product_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Products' lists of sources, from a model and recovered: the URLs they show and the best three; some products have no list."""
    i = F.col("id")
    entry = lambda a, b, c: F.struct(F.concat(F.lit("u"), a).alias("url"), b.cast("int").alias("rank"), c.cast("int").alias("score"))
    said = F.when(i % 6 != 0, F.array(entry(i % 5, i % 4, i % 7), entry(i % 3, i % 2, i % 9)))
    recovered = F.when(i % 4 != 0, F.array(F.struct(F.when(i % 8 == 1, "").otherwise(F.concat(F.lit("r"), i % 2)).alias("url"), (i % 3).cast("int").alias("rank"), F.lit(None).cast("int").alias("score"))))
    rows = posts(spark, folder).select("id", products.all_claims(said, recovered).alias("sources"))
    return products.listed_sources(rows, ["id"], "sources", 3).withColumn("top", F.concat_ws(",", "top"))


SOURCES_SQL = """, e AS (SELECT id, unnest(list_concat(CASE WHEN id % 6 <> 0 THEN [struct_pack(u := 'u' || (id % 5), r := id % 4, s := id % 7), struct_pack(u := 'u' || (id % 3), r := id % 2, s := id % 9)] ELSE [] END, CASE WHEN id % 4 <> 0 THEN [struct_pack(u := CASE WHEN id % 8 = 1 THEN NULL ELSE 'r' || (id % 2) END, r := id % 3, s := 0)] ELSE [] END)) AS x FROM posts),
b AS (SELECT id, x.u AS u, max((x.r, x.s)) AS m FROM e WHERE x.u IS NOT NULL GROUP BY ALL), t AS (SELECT id, count(*) AS n, list(u ORDER BY m[1] DESC, m[2] DESC, u)[1:3] AS l FROM b GROUP BY id)
SELECT p.id, coalesce(n, 0) AS n_urls, coalesce(array_to_string(l, ','), '') AS top FROM posts p LEFT JOIN t USING (id)"""


def recent_targeted(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of posts of two weeks before the last two days."""
    p = posts(spark, folder).withColumn("content", F.when(F.col("id") % 3 == 0, "more")).withColumn("title", F.when(F.col("id") % 5 != 0, F.col("title"))).withColumn("model_id", F.when(F.col("id") % 7 == 0, "unknown").otherwise(F.col("model_id")))
    return queue.recent_targeted(p, models(spark), now(), days=14, before=ago(days=2), offset=40, size=120)


def shown_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts with source and age in words, and the place of their model in the list."""
    p = posts(spark, folder).join(models(spark).select("model_id", "slug"), "model_id")
    return p.select("id", taxonomy.source_label(F.col("source")).alias("source_label"), taxonomy.time_ago(F.when(F.col("id") % 9 != 0, F.col("posted_at")), ago(days=5)).alias("age"), taxonomy.in_order(F.col("slug"), taxonomy.MODEL_ORDER).alias("place"))


def error_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The log's real errors by context, as an object without nulls."""
    e = errors(spark, folder).withColumn("context", F.when(F.col("id") % 6 == 0, "summary").when(F.col("id") % 6 == 1, "fetch-retry").when(F.col("id") % 6 == 2, "match-debug").otherwise(F.col("context")))
    rows = e.where(~monitor.is_noise(F.col("context"))).groupBy("function_name").agg(F.count(F.lit(1)).alias("n"), F.min("error_message").alias("least"), F.max(F.when(F.col("severity") == "critical", F.col("id"))).alias("critical"))
    return rows.select("function_name", monitor.without_nulls(n=F.col("n"), critical=F.when(F.col("critical") % 2 == 0, F.col("critical"))).alias("summary"))


QUERIES = {
    "landed_comments_named": landed_comments_named,
    "released_from_feed": released_from_feed,
    "listed_models": listed_models,
    "landed_pairs": landed_pairs,
    "priced_lineup": priced_lineup,
    "product_sources": product_sources,
    "recent_targeted": recent_targeted,
    "shown_posts": shown_posts,
    "error_contexts": error_contexts,
}
_LABEL = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in taxonomy.SOURCE_LABELS.items()) + " ELSE source END"
ORACLE = {
    "landed_comments_named": with_posts(_comments_sql()),
    "released_from_feed": with_posts(RELEASED_SQL),
    "listed_models": with_posts(MODELS_SQL),
    "landed_pairs": with_posts(f", {BASE_SQL} SELECT 'm' || i AS a, 'm' || (i + 1) AS b, n / 100.0::DOUBLE AS delta, n / 200.0::DOUBLE AS lo, NULL::DOUBLE AS hi, CASE WHEN i % 2 = 0 THEN 0.01::DOUBLE END AS p, CASE WHEN i % 2 = 0 THEN 'm' || i END AS winner FROM base WHERE i % 9 <> 0"),
    "priced_lineup": PRICED_SQL,
    "product_sources": with_posts(SOURCES_SQL),
    "recent_targeted": with_posts(f", p AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'unknown' ELSE model_id END AS mid, trim(CASE WHEN id % 5 <> 0 THEN title ELSE '' END || ' ' || CASE WHEN id % 3 = 0 THEN 'more' ELSE '' END) AS text FROM posts WHERE posted_at >= {N} - INTERVAL 14 DAY AND posted_at < {N} - INTERVAL 2 DAY ORDER BY posted_at DESC, id LIMIT 120 OFFSET 40) SELECT id, text, slug AS model_slug FROM p JOIN models m ON m.model_id = mid WHERE text <> ''"),
    "shown_posts": with_posts(f" SELECT id, {_LABEL} AS source_label, CASE WHEN id % 9 = 0 THEN '' WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS age, (list_position({sql_list(taxonomy.MODEL_ORDER)}, slug) - 1)::INTEGER AS place FROM (SELECT *, floor(epoch({N} - INTERVAL 5 DAY - posted_at) / 60)::BIGINT AS m FROM posts JOIN models USING (model_id))"),
    "error_contexts": f"WITH {ERRORS_SQL} SELECT function_name, '{{\"n\":' || count(*) || CASE WHEN max(id) FILTER (severity = 'critical') % 2 = 0 THEN ',\"critical\":' || max(id) FILTER (severity = 'critical') ELSE '' END || '}}' AS summary FROM errors WHERE id % 6 > 2 GROUP BY function_name",
}
