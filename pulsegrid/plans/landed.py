"""Queries over landed files. The test tables are written as pages of platforms' APIs, feeds and ledgers, and read back by the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import text
from pulsegrid.plans.views import NOW, ago, now, posts, with_posts
from pulsegrid.shared import write_text
from pulsegrid.sources import landed

PAGE = 50
SUBREDDITS = ["r/ClaudeAI", "r/OpenAI", "r/GeminiAI", "r/Grok", "r/other"]
APPS = [("111", "claude", "Claude"), ("222", "chatgpt", "ChatGPT"), ("333", "gemini", "Gemini")]
REPOS = ["anthropics/claude-code", "openai/codex", "google-gemini/gemini-cli"]
PREFIXES = ["anthropic/", "openai/", "google/", "x-ai/", "other/", "~anthropic/"]
STATUS_WORDS = ["Major outage", "Elevated errors", "Scheduled maintenance", "All fine"]
PRODUCTS = ["Vertex Gemini API", "Compute Engine", "Google Cloud Storage"]
BODY = "<p>Post &#8220;{}&#8221; is <b>good</b> &amp; long &#x2014; enough to read</p>"
ISSUE = "### Environment\nEnvironment:\nIt fails <!-- hidden --> after ```code``` update {} ![x](y)\n\n\n\nsad"


def base(spark: SparkSession, folder: str) -> DataFrame:
    """Posts as what a collector would meet: i, at (a time in text), at_s, title, n."""
    p = posts(spark, folder).select(F.col("id").alias("i"), "posted_at", F.col("engagement").alias("n"), "k")
    return p.withColumn("at", F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


SECOND = "date_trunc('second', posted_at)"
BASE_SQL = f"base AS (SELECT id AS i, {SECOND} AS tm, posted_at, engagement AS n, k FROM posts)"


def said(pattern: str, value: Column) -> Column:
    """The pattern with the value in its braces."""
    return F.replace(F.lit(pattern), F.lit("{}"), value.cast("string"))


def said_sql(pattern: str, value: str) -> str:
    quoted = [part.replace("'", "''") for part in pattern.split("{}")]
    return "(" + f" || {value} || ".join("'" + q + "'" for q in quoted) + ")"


def land(rows: DataFrame, item: Column, name: str, field: str | None = None) -> str:
    """Write items as JSON lines, in pages of ``PAGE`` under ``field`` where one is given; every item comes in two pages."""
    one = rows.select("i", item.alias("item")).withColumn("twice", F.explode(F.array(F.lit(0), F.lit(1))))
    if not field:
        return write_text(one.select(F.to_json("item")), name)
    paged = one.groupBy(F.floor(F.col("i") / PAGE), "twice").agg(F.collect_list("item").alias(field))
    return write_text(paged.select(F.to_json(F.struct(field))), name)


def struct(**columns: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in columns.items()))


def landed_stories(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("i")
    item = struct(objectID=i.cast("string"), title=F.concat(F.lit("Title "), i), story_text=F.when(i % 2 == 0, said(BODY, i)), points=F.when(i % 5 != 0, F.col("n")), created_at=F.col("at"), author=F.concat(F.lit("a"), i % 9))
    return landed.hacker_news_stories(spark, land(base(spark, folder), item, "hn", "hits"), ago(hours=24))


def landed_comments(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("i")
    item = struct(objectID=i.cast("string"), comment_text=F.when(i % 2 == 0, said(BODY, i)).otherwise("short"), points=F.col("n"), created_at=F.col("at"), author=F.concat(F.lit("a"), i % 9))
    return landed.hacker_news_comments(spark, land(base(spark, folder), item, "hn-comments", "hits"), ago(days=3)).drop("title")


def landed_bluesky(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("i")
    uri = lambda c: F.concat(F.lit("at://did/app.bsky.feed.post/"), c)
    shapes = struct(record=F.when(i % 4 < 2, struct(uri=F.when(i % 4 == 0, uri(F.concat(F.lit("q"), i))), record=F.when(i % 4 == 1, struct(uri=uri(F.concat(F.lit("r"), i)))))), quoted=F.when(i % 4 == 2, struct(uri=uri(F.concat(F.lit("s"), i)))))
    item = struct(uri=uri(F.concat(F.lit("p"), i)), likeCount=F.when(i % 3 != 0, F.col("n")), author=struct(handle=F.concat(F.lit("u"), i % 50, F.lit(".bsky"))), record=struct(text=F.concat(F.lit("Saying "), i), createdAt=F.col("at")), embed=shapes)
    return landed.bluesky(spark, land(base(spark, folder), item, "bsky", "posts"), ago(days=2)).drop("body")


def landed_mastodon(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("i")
    item = struct(url=F.concat(F.lit("https://m.social/"), i - i % 2), content=F.when(i % 10 < 2, F.lit("<p>My Zodiac says</p>")).otherwise(said(BODY, i - i % 2)), created_at=F.date_format(F.date_trunc("day", "posted_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), favourites_count=(i - i % 2).cast("int"), reblogs_count=F.lit(2), account=struct(acct=F.concat(F.lit("m"), i - i % 2)))
    return landed.mastodon(spark, land(base(spark, folder), item, "masto"), ago(days=2)).drop("title")


def landed_twitter(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("i")
    odd = i % 2 == 1
    item = struct(
        id=i.cast("string"), text=F.when(odd, F.concat(F.lit("Tweet "), i)), full_text=F.when(~odd, F.concat(F.lit("Full "), i)), url=F.when(i % 3 == 0, F.concat(F.lit("https://x.com/z/status/"), i)), created_at=F.when(odd, F.col("at")), createdAt=F.when(~odd, F.col("at")),
        isRetweet=F.when(i % 7 == 0, F.lit(True)), username=F.when(odd, F.concat(F.lit("u"), i % 40)), favorite_count=F.when(odd, F.col("n")), likeCount=F.when(~odd, F.col("n")), retweetCount=(i % 4).cast("int"),
        author=struct(userName=F.concat(F.lit("v"), i % 40), isBlueVerified=i % 5 == 0, followers=(i % 3 * 1000).cast("int")),
    )
    return landed.twitter(spark, land(base(spark, folder), item, "tw"), ago(days=2))


def landed_reddit(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("i")
    name = F.element_at(F.array(*map(F.lit, SUBREDDITS)), (i % len(SUBREDDITS)).cast("int") + 1)
    item = struct(title=F.concat(F.lit("T "), i), body=F.when(i % 2 == 0, F.lit("text")), communityName=name, upVotes=F.col("n"), createdAt=F.col("at"), postUrl=F.when(i % 3 == 0, F.concat(F.lit("https://reddit.com/a/"), i)), url=F.concat(F.lit("https://reddit.com/b/"), i), username=F.lit("r"))
    return landed.reddit(spark, land(base(spark, folder), item, "reddit"), ago(days=2))


def landed_reviews(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("i")
    app = F.element_at(F.array(*(F.lit(a[0]) for a in APPS)), (i % len(APPS)).cast("int") + 1)
    label = lambda c: struct(label=c.cast("string"))
    item = struct(app_id=app, id=label(i), title=label(F.when(i % 2 == 0, F.lit(" Nice "))), content=label(F.concat(F.lit(" keeps making things up "), i)), updated=label(F.col("at")), rating=label(i % 7))
    apps = spark.createDataFrame(APPS, "app_id string, slug string, name string")
    return landed.app_store(spark, land(base(spark, folder), item, "apps"), now(), apps)


def landed_issues(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("i")
    repo = F.element_at(F.array(*map(F.lit, REPOS)), (i % len(REPOS)).cast("int") + 1)
    item = struct(html_url=F.concat(F.lit("https://github.com/"), repo, F.lit("/issues/"), i), title=F.concat(F.lit("[Bug] crash "), i), body=said(ISSUE, i), created_at=F.col("at"), comments=(i % 5).cast("int"), reactions=struct(total_count=F.col("n")), user=struct(login=F.lit("dev"), type=F.when(i % 11 == 0, "Bot").otherwise("User")), pull_request=F.when(i % 13 == 0, struct(url=F.lit("x"))))
    return landed.github_issues(spark, land(base(spark, folder), item, "issues"), now())


def landed_models(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("i")
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (i % len(PREFIXES)).cast("int") + 1)
    item = struct(id=F.concat(prefix, F.lit("m"), i, F.when(i % 9 == 0, ":free").otherwise("")), name=F.when(i % 2 == 0, F.concat(F.lit("Model "), i)), created=F.unix_timestamp("posted_at"), description=F.when(i % 4 == 0, F.lit(" A  good\nmodel ")), context_length=(i % 3 * 100000), pricing=struct(prompt=F.when(i % 5 == 0, "0").otherwise("0.0000025"), completion=F.lit("0.00001")))
    rows = base(spark, folder)
    known = rows.where("k % 10 = 0").select(F.concat(F.lit("https://openrouter.ai/"), prefix, F.lit("m"), i).alias("source_url"))
    return landed.new_models(spark, land(rows, item, "models", "data"), known, now())


def feed(rows: DataFrame, entry: Column, name: str, pages: int = 20) -> str:
    """Entries as XML documents, one file each."""
    parts = rows.groupBy(F.floor(F.col("i") / 2) % pages).agg(F.collect_list(entry).alias("x"))
    return write_text(parts.select(F.concat(F.lit("<?xml version='1.0'?><feed>"), F.array_join("x", "\n"), F.lit("</feed>"))), name, 1)


def landed_status(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of an Atom and an RSS feed."""
    i = F.col("i")
    word = F.element_at(F.array(*map(F.lit, STATUS_WORDS)), (F.floor(i / 2) % len(STATUS_WORDS)).cast("int") + 1)
    rows = base(spark, folder)
    atom = F.concat(F.lit("<entry><id>e"), i, F.lit("</id><title>"), word, F.lit("</title><updated>"), "at", F.lit("</updated><summary type=\"html\">&lt;p&gt;For "), i, F.lit("&lt;/p&gt;</summary><link href=\"https://s/"), i, F.lit("\"/></entry>"))
    rss = F.concat(F.lit("<item><guid>e"), i, F.lit("</guid><title><![CDATA["), word, F.lit("]]></title><pubDate>"), F.date_format("posted_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate><description>For "), i, F.lit("</description><link>https://s/"), i, F.lit("</link></item>"))
    found = [landed.atom_status(spark, feed(rows.where("i % 2 = 0"), atom, "atom"), ago(days=2)), landed.rss_status(spark, feed(rows.where("i % 2 = 1"), rss, "rss"), ago(days=2))]
    return found[0].unionByName(found[1])


def landed_incidents(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("i")
    product = F.element_at(F.array(*map(F.lit, PRODUCTS)), (i % len(PRODUCTS)).cast("int") + 1)
    item = struct(id=F.when(i % 2 == 0, F.concat(F.lit("id"), i)), number=F.concat(F.lit("nr"), i), external_desc=F.when(i % 5 != 0, F.concat(F.lit("Trouble "), i)), begin=F.col("at"), uri=F.when(i % 4 == 0, F.concat(F.lit("/i/"), i)), severity=F.when(i % 3 == 0, "HIGH").when(i % 7 == 0, "low"), affected_products=F.array(struct(title=product)))
    return landed.cloud_incidents(spark, land(base(spark, folder), item, "incidents"), ago(days=2)).distinct()


def landed_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of registries of 40 models each, which land as the documents of YAML streams: a file for each would cost more than its content."""
    i = F.col("i")
    p = base(spark, folder)
    lines = F.concat(F.lit("  - name: \"model "), i, F.lit("\"\n    vendor: v"), i % 3, F.lit("\n    price_pending:\n      date: "), F.substring("at", 1, 10), F.lit("\n      price: "), F.col("n"), F.lit("\n    ranked: "), (i % 2 == 0).cast("string"), F.lit("\n"))
    documents = p.groupBy(F.floor(i / 40)).agg(F.concat(F.lit("---\nmodels:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", lines.alias("l")))), lambda x: x["l"]), "")).alias("value"))
    e = F.col("entry")
    found = landed.registry(spark, write_text(documents.select("value"), "registry"))
    return found.select(e["name"].alias("name"), e["vendor"].alias("vendor"), e["price_pending.date"].alias("price_date"), e["price_pending.price"].alias("price"), e["ranked"].alias("ranked"))


def landed_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the last run."""
    i = F.col("i")
    p = base(spark, folder).where("k < 90")
    runs = p.groupBy((i % 20).alias("run")).agg(F.collect_list(struct(name=F.concat(F.lit("m"), i), score=F.col("n") * 1.0)).alias("scores"))
    run = struct(run_id=F.concat(F.lit("r"), F.lpad(F.col("run").cast("string"), 2, "0")), finished_at=F.concat(F.lit("2024-01-"), F.lpad((F.col("run") + 1).cast("string"), 2, "0")), scores=F.col("scores"))
    return landed.last_run(spark, write_text(runs.select(F.to_json(struct(runs=F.array(run)))), "ledger", 1))


QUERIES = {
    "landed_stories": landed_stories,
    "landed_comments": landed_comments,
    "landed_bluesky": landed_bluesky,
    "landed_mastodon": landed_mastodon,
    "landed_twitter": landed_twitter,
    "landed_reddit": landed_reddit,
    "landed_reviews": landed_reviews,
    "landed_issues": landed_issues,
    "landed_models": landed_models,
    "landed_status": landed_status,
    "landed_incidents": landed_incidents,
    "landed_registry": landed_registry,
    "landed_ledger": landed_ledger,
}
_NOW = f"TIMESTAMP '{NOW}'"
_since = lambda span: f"tm >= {_NOW} - INTERVAL {span}"
_plain = text.decoded_sql(text.plain_html_sql(said_sql(BODY, "i")))
_tags = text.decoded_sql(f"regexp_replace({said_sql(BODY, 'i')}, '<[^>]*>', '', 'g')")
_pick = lambda values, place: "([" + ", ".join(f"'{v}'" for v in values) + f"])[({place}) + 1]"
_STARS = "CASE WHEN i % 7 BETWEEN 1 AND 5 THEN ' (' || (i % 7) || '/5 star ' ELSE ' (' END || 'App Store review of the ' || " + _pick([a[2] for a in APPS], f"i % {len(APPS)}") + " || ' iOS app)'"
_ID = f"{_pick(PREFIXES, f'i % {len(PREFIXES)}')} || 'm' || i"
_NAME = f"CASE WHEN i % 2 = 0 THEN 'Model ' || i ELSE {_ID} END"
ORACLE = {name: with_posts(f", {BASE_SQL} {sql}") for name, sql in {
    "landed_stories": f"SELECT 'hackernews' AS source, 'https://news.ycombinator.com/item?id=' || i AS source_url, 'Title ' || i AS title, CASE WHEN i % 2 = 0 THEN {_plain} END AS body, CASE WHEN i % 2 = 0 THEN 'title_and_body' ELSE 'title_only' END AS content_type, CASE WHEN i % 5 <> 0 THEN n ELSE 0 END AS engagement, tm AS posted_at, 'a' || (i % 9) AS author_handle FROM base WHERE {_since('24 HOUR')}",
    "landed_comments": f"SELECT 'hackernews' AS source, 'https://news.ycombinator.com/item?id=' || i AS source_url, {_plain} AS body, 'comment' AS content_type, n AS engagement, tm AS posted_at, 'a' || (i % 9) AS author_handle FROM base WHERE i % 2 = 0 AND {_since('3 DAY')} ORDER BY posted_at DESC, source_url LIMIT 60",
    "landed_bluesky": f"SELECT 'bluesky' AS source, 'https://bsky.app/profile/u' || (i % 50) || '.bsky/post/p' || i AS source_url, 'Saying ' || i AS title, 'title_only' AS content_type, CASE WHEN i % 3 <> 0 THEN n ELSE 0 END AS engagement, tm AS posted_at, 'u' || (i % 50) || '.bsky' AS author_handle, CASE i % 4 WHEN 0 THEN 'q' || i WHEN 1 THEN 'r' || i WHEN 2 THEN 's' || i END AS quoted FROM base WHERE {_since('2 DAY')}",
    "landed_mastodon": f"SELECT 'mastodon' AS source, 'https://m.social/' || i AS source_url, {_tags.replace('&amp;', '&amp;')} AS body, 'title_and_body' AS content_type, (i + 2)::INTEGER AS engagement, d AS posted_at, 'm' || i AS author_handle FROM (SELECT i - i % 2 AS i, min(date_trunc('day', posted_at)) AS d FROM base WHERE i % 10 >= 2 GROUP BY 1) WHERE d >= {_NOW} - INTERVAL 2 DAY",
    "landed_twitter": f"SELECT 'twitter' AS source, CASE WHEN i % 3 = 0 THEN 'https://x.com/z/status/' || i ELSE 'https://x.com/' || h || '/status/' || i END AS source_url, CASE WHEN i % 2 = 1 THEN 'Tweet ' ELSE 'Full ' END || i AS title, NULL::VARCHAR AS body, 'title_only' AS content_type, (n + i % 4)::INTEGER AS engagement, tm AS posted_at, h AS author_handle, i % 5 = 0 AS verified, nullif(i % 3 * 1000, 0)::INTEGER AS followers FROM (SELECT *, CASE WHEN i % 2 = 1 THEN 'u' ELSE 'v' END || (i % 40) AS h FROM base) WHERE i % 7 <> 0 AND {_since('2 DAY')}",
    "landed_reddit": f"SELECT 'reddit' AS source, CASE WHEN i % 3 = 0 THEN 'https://reddit.com/a/' ELSE 'https://reddit.com/b/' END || i AS source_url, 'T ' || i AS title, CASE WHEN i % 2 = 0 THEN 'text' ELSE '' END AS body, 'title_and_body' AS content_type, n AS engagement, tm AS posted_at, 'r' AS author_handle, (['claude', 'chatgpt', 'gemini', 'grok', NULL])[i % 5 + 1] AS slug FROM base WHERE {_since('2 DAY')}",
    "landed_reviews": f"SELECT 'appstore' AS source, 'https://apps.apple.com/us/app/id' || a || '#review-' || i AS source_url, CASE WHEN i % 2 = 0 THEN 'Nice' END AS title, 'keeps making things up ' || i || {_STARS} AS body, 'title_and_body' AS content_type, 0 AS engagement, tm AS posted_at, NULL::VARCHAR AS author_handle, a AS app_id FROM (SELECT *, {_pick([a[0] for a in APPS], f'i % {len(APPS)}')} AS a FROM base WHERE {_since('7 DAY')}) QUALIFY row_number() OVER (PARTITION BY a ORDER BY tm DESC, source_url) <= 15",
    "landed_issues": f"SELECT 'github' AS source, 'https://github.com/' || r || '/issues/' || i AS source_url, 'crash ' || i AS title, 'It fails after update ' || i || ' ' || chr(10) || chr(10) || 'sad' AS body, 'title_and_body' AS content_type, (n + i % 5)::INTEGER AS engagement, tm AS posted_at, 'dev' AS author_handle, r AS repo FROM (SELECT *, {_pick(REPOS, f'i % {len(REPOS)}')} AS r FROM base WHERE i % 11 <> 0 AND i % 13 <> 0 AND {_since('3 DAY')}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY tm DESC, source_url) <= 25",
    "landed_models": f"SELECT 'openrouter' AS source, 'https://openrouter.ai/' || d AS source_url, 'New model listed on OpenRouter: ' || nm AS title, nm || ' (' || d || ') was spotted in the API on OpenRouter on ' || strftime(tm, '%Y-%m-%d') || ' — a new model slug listed by the provider.' || (['', ' Context window 100,000 tokens.', ' Context window 200,000 tokens.'])[i % 3 + 1] || CASE WHEN i % 5 <> 0 THEN ' Pricing $2.50/M input, $10.00/M output.' ELSE '' END || CASE WHEN i % 4 = 0 THEN ' Provider description: A good model' ELSE '' END AS body, 'title_and_body' AS content_type, 0 AS engagement, tm AS posted_at, 'openrouter' AS author_handle FROM (SELECT *, {_ID} AS d, {_NAME} AS nm FROM base) WHERE i % 6 < 4 AND i % 9 <> 0 AND k % 10 <> 0 AND {_since('7 DAY')}",
    "landed_status": f"SELECT 'e' || i AS id, w AS title, tm AS updated_at, 'For ' || i AS summary, 'https://s/' || i AS url, (['major', 'minor', 'maintenance', 'unknown'])[i // 2 % 4 + 1] AS severity FROM (SELECT *, {_pick(STATUS_WORDS, 'i // 2 % 4')} AS w FROM base) WHERE {_since('2 DAY')}",
    "landed_incidents": f"SELECT CASE WHEN i % 2 = 0 THEN 'id' ELSE 'nr' END || i AS id, CASE WHEN i % 5 <> 0 THEN 'Trouble ' || i ELSE '{PRODUCTS[0]}' END AS title, tm AS updated_at, 'Affected: {PRODUCTS[0]}' AS summary, CASE WHEN i % 4 = 0 THEN 'https://status.cloud.google.com/i/' || i END AS url, CASE WHEN i % 3 = 0 THEN 'major' WHEN i % 7 = 0 THEN 'minor' ELSE 'unknown' END AS severity FROM base WHERE i % 3 = 0 AND {_since('2 DAY')}",
    "landed_registry": "SELECT 'model ' || i AS name, 'v' || (i % 3) AS vendor, strftime(tm, '%Y-%m-%d') AS price_date, n::VARCHAR AS price, CASE WHEN i % 2 = 0 THEN 'true' ELSE 'false' END AS ranked FROM base",
    "landed_ledger": "SELECT 'r19' AS run_id, 'm' || i AS name, n * 1.0::DOUBLE AS score FROM base WHERE i % 20 = 19 AND k < 90",
}.items()}
