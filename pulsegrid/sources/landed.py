"""Readers of what collectors have landed: pages of platforms' APIs as JSON lines, feeds as XML, tables as CSV.

Each reader is a plain scan with a stated schema and one projection to the columns of a post: source, source_url, title, body,
content_type, engagement, posted_at, author_handle. Fields that an API names in several ways are coalesced. Pages overlap, so rows
are made distinct by their URL. Text filters and attribution are operators of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import text

POST = ["source", "source_url", "title", "body", "content_type", "engagement", "posted_at", "author_handle"]

# Communities of models, vendors' prefixes, words of another field, headings of issue forms.
SUBREDDITS = {"claudeai": "claude", "claudecode": "claude", "chatgpt": "chatgpt", "openai": "chatgpt", "googlegemini": "gemini", "geminiai": "gemini", "googlegeminiai": "gemini", "grok": "grok"}
VENDORS = {"anthropic/": "claude", "openai/": "chatgpt", "google/": "gemini", "x-ai/": "grok"}
ASTROLOGY = ["horoscope", "zodiac", "mercury retrograde", "natal chart", "birth chart", "sun sign", "moon sign", "rising sign", "astrology"]
HEADINGS = "Environment|Version|Steps to reproduce|Expected behavior|Actual behavior|Additional context|Platform|Operating system|Terminal|Claude Code version|Model"
INCIDENT_PRODUCTS = "(?i)(gemini|generative|vertex|ai studio|generativelanguage)"


MASTODON = "url string, content string, created_at string, favourites_count int, reblogs_count int, account struct<acct:string>"
REDDIT = "title string, body string, communityName string, upVotes int, createdAt string, postUrl string, url string, username string"
REVIEWS = "app_id string, id struct<label:string>, title struct<label:string>, content struct<label:string>, updated struct<label:string>, rating struct<label:string>"
ISSUES = "repo string, html_url string, title string, body string, created_at string, comments int, reactions struct<total_count:int>, user struct<login:string,type:string>, pull_request struct<url:string>"
CATALOGUE = "data array<struct<id:string,name:string,created:bigint,description:string,context_length:bigint,pricing:struct<prompt:string,completion:string>>>"


def pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def items(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """The items of landed pages, each as a struct ``item`` beside its ``file``; a page that can't be read is one row with its text as ``unreadable``.

    With a field, a page is one JSON object whose field lists the items; without, each line is one. A page of which only some fields have the wrong type keeps
    its items, with nulls there.
    """
    kind = f"{schema}, _unreadable string"
    rows = spark.read.schema(kind).option("columnNameOfCorruptRecord", "_unreadable").json(path).withColumn("file", F.col("_metadata.file_path"))
    if field:
        broken = F.col(field).isNull() & F.col("_unreadable").isNotNull()
        none = F.array(F.lit(None).cast(rows.schema[field].dataType.elementType))
        listed = rows.select("file", F.when(broken, F.col("_unreadable")).alias("unreadable"), F.explode(F.when(broken, none).otherwise(F.coalesce(F.col(field), F.array().cast(rows.schema[field].dataType)))).alias("item"))
        return listed
    own = [c for c in rows.columns if c not in ("_unreadable", "file")]
    nothing = F.lit(True)
    for c in own:
        nothing = nothing & F.col(c).isNull()
    broken = nothing & F.col("_unreadable").isNotNull()
    return rows.select("file", F.when(broken, F.col("_unreadable")).alias("unreadable"), F.when(~broken, F.struct(*own)).alias("item"))


def judged(items: DataFrame, url: Column, at: Column) -> DataFrame:
    """Items with ``reason``: why one can't become a post (unreadable, no_url, no_time), null for those that can."""
    reason = F.when(F.col("unreadable").isNotNull() | F.col("item").isNull(), "unreadable").when(F.coalesce(url, F.lit("")) == "", "no_url").when(at.isNull(), "no_time")
    return items.withColumn("reason", reason)


def quarantined(judged: DataFrame) -> DataFrame:
    """(file, reason, record): what is put aside, for a table of its own."""
    return judged.where("reason is not null").select("file", "reason", F.coalesce("unreadable", F.to_json("item")).alias("record"))


@dataclass(frozen=True)
class Shape:
    """How a source's pages list items, and what of an item becomes a post's URL and time."""

    schema: str
    field: str | None
    url: Callable[[Column], Column]
    at: Callable[[Column], Column]


def shapes() -> dict[str, Shape]:
    """The sources whose pages are JSON, by name."""
    first = lambda i, *names: F.coalesce(*(F.nullif(i[n], F.lit("")) for n in names))
    return {
        "hackernews": Shape(HACKER_NEWS, "hits", lambda i: i["objectID"], lambda i: instant(i["created_at"])),
        "bluesky": Shape(BLUESKY, "posts", lambda i: i["uri"], lambda i: instant(i["record"]["createdAt"])),
        "mastodon": Shape(MASTODON, None, lambda i: i["url"], lambda i: instant(i["created_at"])),
        "twitter": Shape(TWITTER, None, lambda i: first(i, "url", "id"), lambda i: F.coalesce(instant(i["created_at"]), instant(i["createdAt"]))),
        "reddit": Shape(REDDIT, None, lambda i: first(i, "postUrl", "url"), lambda i: instant(i["createdAt"])),
        "appstore": Shape(REVIEWS, None, lambda i: i["id"]["label"], lambda i: instant(i["updated"]["label"])),
        "github": Shape(ISSUES, None, lambda i: i["html_url"], lambda i: instant(i["created_at"])),
        "openrouter": Shape(CATALOGUE, "data", lambda i: i["id"], lambda i: F.timestamp_seconds(i["created"])),
    }


def quarantine(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(file, reason, record) of a source's landed items that can't become posts: pages that can't be read, items without URL or readable time."""
    shape = shapes()[source]
    item = F.col("item")
    return quarantined(judged(items(spark, path, shape.schema, shape.field), shape.url(item), shape.at(item)))


def stories(spark: SparkSession, path: str) -> DataFrame:
    """Stories of landed pages, judged; those without a title are no stories and play no part."""
    given = items(spark, path, HACKER_NEWS, "hits").where("unreadable is not null or item is null or item.title is not null or item.comment_text is null")
    return judged(given, F.col("item.objectID"), instant(F.col("item.created_at")))


def story_posts(stories: DataFrame) -> DataFrame:
    """The posts among judged stories."""
    h = stories.where("reason is null and coalesce(item.title, '') <> ''").select("item.*")
    body = F.nullif(text.decoded(text.plain_html(F.coalesce("story_text", F.lit("")))), F.lit(""))
    kind = F.when(body.isNull(), "title_only").otherwise("title_and_body")
    return post(h, "hackernews", {"link": F.col("url")}, source_url=F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID"), title=F.col("title"), body=body, content_type=kind, engagement=F.coalesce("points", F.lit(0)), posted_at=instant(F.col("created_at")), author_handle=F.col("author"))


def one_each(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Of rows with equal keys the first by an order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def post(rows: DataFrame, source: str, extra: dict[str, Column] | None = None, **columns: Column) -> DataFrame:
    """The columns of a post, and ``extra`` ones; one row for each URL, none without URL or time."""
    named = {"title": F.lit(None).cast("string"), "body": F.lit(None).cast("string"), "author_handle": F.lit(None).cast("string"), "content_type": F.lit("title_and_body")} | columns
    made = rows.select(F.lit(source).alias("source"), *(named[c].alias(c) for c in POST[1:]), *(c.alias(n) for n, c in (extra or {}).items()))
    return one_each(made.where(F.col("source_url").isNotNull() & F.col("posted_at").isNotNull()), ["source_url"], "posted_at", "title", "body")


def instant(said: Column) -> Column:
    """A time as an API writes it; null if it can't be read."""
    return F.try_to_timestamp(said)


HACKER_NEWS = "hits array<struct<objectID:string,title:string,story_text:string,comment_text:string,url:string,points:int,created_at:string,author:string>>"


def hacker_news_stories(spark: SparkSession, path: str, since: Column) -> DataFrame:
    h = pages(spark, path, HACKER_NEWS).select(F.explode("hits").alias("h")).select("h.*").where("title is not null")
    body = F.nullif(text.decoded(text.plain_html(F.coalesce("story_text", F.lit("")))), F.lit(""))
    kind = F.when(body.isNull(), "title_only").otherwise("title_and_body")
    made = post(h, "hackernews", source_url=F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID"), title=F.col("title"), body=body, content_type=kind, engagement=F.coalesce("points", F.lit(0)), posted_at=instant(F.col("created_at")), author_handle=F.col("author"))
    return made.where(F.col("posted_at") >= since)


def hacker_news_comments(spark: SparkSession, path: str, since: Column, least: int = 40, most: int = 60) -> DataFrame:
    """The latest comments of at least ``least`` characters, ``most`` a run."""
    h = pages(spark, path, HACKER_NEWS).select(F.explode("hits").alias("h")).select("h.*").where("comment_text is not null")
    made = post(h, "hackernews", source_url=F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID"), body=text.decoded(text.plain_html(F.col("comment_text"))), content_type=F.lit("comment"), engagement=F.coalesce("points", F.lit(0)), posted_at=instant(F.col("created_at")), author_handle=F.col("author"))
    return made.where((F.col("posted_at") >= since) & (F.length("body") >= least)).orderBy(F.desc("posted_at"), "source_url").limit(most)


BLUESKY = """posts array<struct<uri:string,likeCount:int,author:struct<handle:string>,record:struct<text:string,createdAt:string>,
  embed:struct<record:struct<uri:string,record:struct<uri:string>>,quoted:struct<uri:string>>>>"""


def bluesky(spark: SparkSession, path: str, since: Column) -> DataFrame:
    """Posts with the id of the post that they quote, whichever of three shapes holds it."""
    p = pages(spark, path, BLUESKY).select(F.explode("posts").alias("p")).select("p.*")
    last = lambda uri: F.element_at(F.split(uri, "/"), -1)
    quoted = last(F.coalesce("embed.record.record.uri", "embed.record.uri", "embed.quoted.uri"))
    url = F.concat(F.lit("https://bsky.app/profile/"), F.coalesce("author.handle", F.lit("")), F.lit("/post/"), last(F.col("uri")))
    made = post(p, "bluesky", {"quoted": quoted}, source_url=url, title=F.col("record.text"), content_type=F.lit("title_only"), engagement=F.coalesce("likeCount", F.lit(0)), posted_at=instant(F.col("record.createdAt")), author_handle=F.nullif(F.col("author.handle"), F.lit("")))
    return made.where(F.col("posted_at") >= since)


def mastodon(spark: SparkSession, path: str, since: Column) -> DataFrame:
    """Statuses of all instances, one for each URL, without those about the stars."""
    s = pages(spark, path, MASTODON)
    plain = text.decoded(F.regexp_replace(F.coalesce("content", F.lit("")), "<[^>]*>", ""))
    made = post(s, "mastodon", source_url=F.col("url"), body=F.trim(plain), engagement=F.coalesce("favourites_count", F.lit(0)) + F.coalesce("reblogs_count", F.lit(0)), posted_at=instant(F.col("created_at")), author_handle=F.col("account.acct"))
    return made.where((F.col("posted_at") >= since) & ~F.lower("body").rlike("|".join(ASTROLOGY)))


TWITTER = """id string, text string, full_text string, url string, created_at string, createdAt string, isRetweet boolean, is_retweet boolean, username string, screen_name string,
  favorite_count int, likeCount int, retweet_count int, retweetCount int, isVerified boolean, author struct<userName:string,isBlueVerified:boolean,followers:int,followers_count:int>"""


def twitter(spark: SparkSession, path: str, since: Column) -> DataFrame:
    """Items without retweets, with the author's verification and followers."""
    t = pages(spark, path, TWITTER).where(~F.coalesce("isRetweet", "is_retweet", F.lit(False)))
    name = F.coalesce("username", "screen_name", "author.userName")
    url = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("https://x.com/"), name, F.lit("/status/"), "id"))
    likes = lambda *c: F.coalesce(*c, F.lit(0))
    extra = {"verified": F.coalesce("isVerified", "author.isBlueVerified", F.lit(False)), "followers": F.nullif(F.coalesce("author.followers", "author.followers_count"), F.lit(0))}
    said = F.substring(F.coalesce("text", "full_text"), 1, 2000)
    made = post(t, "twitter", extra, source_url=url, title=said, content_type=F.lit("title_only"), engagement=likes("favorite_count", "likeCount") + likes("retweet_count", "retweetCount"), posted_at=F.coalesce(instant(F.col("created_at")), instant(F.col("createdAt"))), author_handle=name)
    return made.where((F.col("posted_at") >= since) & (F.col("title") != ""))


def reddit(spark: SparkSession, path: str, since: Column) -> DataFrame:
    """Posts with the model of their community, if it has one."""
    r = pages(spark, path, REDDIT)
    community = F.lower(F.regexp_replace(F.coalesce("communityName", F.lit("")), "^r/", ""))
    slug = F.try_element_at(F.create_map(*(F.lit(x) for pair in SUBREDDITS.items() for x in pair)), community)
    url = F.coalesce(F.nullif(F.col("postUrl"), F.lit("")), F.nullif(F.col("url"), F.lit("")))
    made = post(r, "reddit", {"slug": slug}, source_url=url, title=F.coalesce("title", F.lit("")), body=F.coalesce("body", F.lit("")), engagement=F.coalesce("upVotes", F.lit(0)), posted_at=instant(F.col("createdAt")), author_handle=F.col("username"))
    return made.where(F.col("posted_at") >= since)


def reddit_comments(spark: SparkSession, path: str, since: Column, least: int = 20) -> DataFrame:
    """Comments of at least ``least`` characters with the community they stand in; each has a URL of its own, the post's with the comment's id where it has none."""
    c = pages(spark, path, "id string, dataType string, body string, communityName string, parsedCommunityName string, upVotes int, score int, createdAt string, commentUrl string, permalink string, url string, postUrl string").where("dataType = 'comment'")
    full = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))
    base = full("commentUrl", "permalink", "url", "postUrl")
    url = F.when(F.coalesce(F.col("id"), F.lit("")).eqNullSafe("") | base.contains(F.col("id")), base).otherwise(F.concat(base, F.lit("#"), "id"))
    said, votes = F.trim(F.coalesce("body", F.lit(""))), F.coalesce(F.nullif("upVotes", F.lit(0)), F.nullif("score", F.lit(0)), F.lit(0))
    community = F.coalesce(full("communityName", "parsedCommunityName"), F.lit(""))
    made = post(c.where(F.length(said) >= least), "reddit", {"community": community}, source_url=url, body=F.substring(said, 1, 2000), content_type=F.lit("comment"), engagement=votes, posted_at=instant(F.col("createdAt")))
    return made.where(F.col("posted_at") >= since)


def app_store(spark: SparkSession, path: str, now: Column, models: DataFrame, days: int = 7, most: int = 15) -> DataFrame:
    """The latest reviews of each app (app_id, slug, name in ``models``), at most ``most`` a run; the rating goes with the text."""
    e = pages(spark, path, REVIEWS)
    e = e.join(F.broadcast(models), "app_id").where("id.label <> '' and trim(content.label) <> ''")
    label = F.concat(F.lit("App Store review of the "), "name", F.lit(" iOS app"))
    stars = F.col("rating.label").cast("int")
    suffix = F.when(stars.between(1, 5), F.concat(F.lit(" ("), stars.cast("string"), F.lit("/5 star "), label, F.lit(")"))).otherwise(F.concat(F.lit(" ("), label, F.lit(")")))
    made = post(e, "appstore", source_url=F.concat(F.lit("https://apps.apple.com/us/app/id"), "app_id", F.lit("#review-"), "id.label"), title=F.nullif(F.substring(F.trim(F.col("title.label")), 1, 120), F.lit("")), body=F.concat(F.substring(F.trim(F.col("content.label")), 1, 1900), suffix), engagement=F.lit(0), posted_at=instant(F.col("updated.label")))
    fresh = made.where(F.col("posted_at") >= now - F.make_dt_interval(days=F.lit(days))).withColumn("app_id", F.regexp_extract("source_url", "/id([^#]*)", 1))
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy("app_id").orderBy(F.desc("posted_at"), "source_url"))).where(F.col("_r") <= most).drop("_r")


def issue_text(body: Column) -> Column:
    """An issue's own words: no comments, code, images, form headings."""
    out = F.coalesce(body, F.lit(""))
    for pattern, to in ((r"<!--[\s\S]*?-->", " "), (r"```[\s\S]*?```", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"(?m)^#+\s*", ""), (rf"(?im)^\s*(?:\*\*)?(?:{HEADINGS})\s*(?:\*\*)?:?\s*$", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def github_issues(spark: SparkSession, path: str, now: Column, days: int = 3, most: int = 25) -> DataFrame:
    """The latest issues of each repository that people opened, at most ``most`` a run."""
    g = pages(spark, path, ISSUES)
    g = g.where("pull_request is null and coalesce(user.type, '') <> 'Bot'")
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?i)^\[(?:bug|feature|feat|question|docs?)[^\]]*\]\s*", ""))
    made = post(g, "github", source_url=F.col("html_url"), title=title, body=F.substring(issue_text(F.col("body")), 1, 1600), engagement=F.coalesce("reactions.total_count", F.lit(0)) + F.coalesce("comments", F.lit(0)), posted_at=instant(F.col("created_at")), author_handle=F.col("user.login"))
    fresh = made.where(F.col("posted_at") >= now - F.make_dt_interval(days=F.lit(days))).withColumn("repo", F.regexp_extract("source_url", "github.com/([^/]+/[^/]+)", 1))
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("posted_at"), "source_url"))).where(F.col("_r") <= most).drop("_r")


def per_million(price: Column) -> Column:
    """A price for one token, written for a million; null unless it's above zero."""
    n = price.try_cast("double")
    return F.when(n > 0, F.concat(F.lit("$"), F.format_string("%.2f", n * 1_000_000)))


def new_models(spark: SparkSession, path: str, known: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Models of a catalogue that aren't among the ``known`` source_urls, as posts: vendors' own ones, no aliases or variants."""
    c = pages(spark, path, CATALOGUE).select(F.explode("data").alias("d")).select("d.*")
    slug = F.lit(None).cast("string")
    for prefix, name in VENDORS.items():
        slug = F.when(F.col("id").startswith(prefix), name).otherwise(slug)
    c = c.where(~F.col("id").startswith("~") & ~F.col("id").contains(":")).withColumn("slug", slug).where("slug is not null")
    name, prices = F.coalesce("name", "id"), [per_million(F.col(f"pricing.{p}")) for p in ("prompt", "completion")]
    listed = F.date_format(F.timestamp_seconds("created"), "yyyy-MM-dd")
    about = F.substring(F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"\s+", " ")), 1, 300)
    body = F.concat(
        name, F.lit(" ("), "id", F.lit(") was spotted in the API on OpenRouter on "), listed, F.lit(" — a new model slug listed by the provider."),
        F.when(F.col("context_length") > 0, F.concat(F.lit(" Context window "), F.format_number("context_length", 0), F.lit(" tokens."))).otherwise(""),
        F.when(prices[0].isNotNull() & prices[1].isNotNull(), F.concat(F.lit(" Pricing "), prices[0], F.lit("/M input, "), prices[1], F.lit("/M output."))).otherwise(""),
        F.when(about != "", F.concat(F.lit(" Provider description: "), about)).otherwise(""),
    )
    made = post(c, "openrouter", source_url=F.concat(F.lit("https://openrouter.ai/"), "id"), title=F.substring(F.concat(F.lit("New model listed on OpenRouter: "), name), 1, 120), body=F.substring(body, 1, 2000), engagement=F.lit(0), posted_at=F.timestamp_seconds("created"), author_handle=F.lit("openrouter"))
    return made.where(F.col("posted_at") >= now - F.make_dt_interval(days=F.lit(days))).join(known.select("source_url"), "source_url", "left_anti").select(*POST)


def severity(title: Column, summary: Column) -> Column:
    """How bad a status entry sounds."""
    said = F.lower(F.concat_ws(" ", title, summary))
    return (
        F.when(said.rlike("scheduled (maintenance|window)"), "maintenance").when(said.rlike("(major|critical|outage|down|unavailable|severe)"), "major")
        .when(said.rlike("(elevated errors?|degraded|partial|increased latency)"), "minor").otherwise("unknown")
    )


def incident_severity(given: Column) -> Column:
    low = F.lower(F.coalesce(given, F.lit("")))
    return F.when(low == "high", "major").when(low.isin("medium", "low"), "minor").otherwise("unknown")


STATUS = ["id", "title", "updated_at", "summary", "url", "severity"]


def status_entries(rows: DataFrame, since: Column, **columns: Column) -> DataFrame:
    plain = lambda c, n: F.substring(text.plain_html(F.coalesce(c, F.lit(""))), 1, n)
    made = rows.select(columns["id"].alias("id"), plain(columns["title"], 200).alias("title"), columns["updated_at"].alias("updated_at"), F.nullif(plain(columns["summary"], 500), F.lit("")).alias("summary"), columns["url"].alias("url"))
    return made.where(F.col("updated_at") >= since).withColumn("severity", severity(F.col("title"), F.col("summary"))).select(*STATUS)


def atom_status(spark: SparkSession, path: str, since: Column) -> DataFrame:
    """Entries of Atom feeds, as Spark's own XML reader splits them."""
    e = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, updated string, published string, summary string, content string, link struct<_href:string>").load(path)
    return status_entries(e, since, id=F.col("id"), title=F.col("title"), updated_at=F.coalesce(instant(F.col("updated")), instant(F.col("published"))), summary=F.coalesce("summary", "content"), url=F.col("link._href"))


def rss_status(spark: SparkSession, path: str, since: Column) -> DataFrame:
    """Items of RSS feeds."""
    i = spark.read.format("xml").option("rowTag", "item").schema("guid string, title string, pubDate string, description string, link string").load(path)
    when = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
    return status_entries(i, since, id=F.col("guid"), title=F.col("title"), updated_at=when, summary=F.col("description"), url=F.col("link"))


def cloud_incidents(spark: SparkSession, path: str, since: Column) -> DataFrame:
    """Incidents of a cloud's feed that touch the model's products."""
    j = pages(spark, path, "id string, number string, external_desc string, begin string, modified string, most_recent_update struct<when:string>, uri string, severity string, affected_products array<struct<title:string>>")
    products = F.coalesce(F.array_join(F.col("affected_products.title"), " "), F.lit(""))
    said = F.coalesce("external_desc", F.lit(""))
    when = F.coalesce(instant(F.col("most_recent_update.when")), instant(F.col("modified")), instant(F.col("begin")))
    rows = j.where(F.concat_ws(" ", products, said).rlike(INCIDENT_PRODUCTS)).select(
        F.coalesce("id", "number").alias("id"), F.coalesce(F.nullif(F.substring(said, 1, 200), F.lit("")), F.nullif(F.substring(products, 1, 200), F.lit("")), F.lit("Google Cloud incident")).alias("title"), when.alias("updated_at"),
        F.when(products != "", F.concat(F.lit("Affected: "), products)).alias("summary"), F.concat(F.lit("https://status.cloud.google.com"), "uri").alias("url"), incident_severity(F.col("severity")).alias("severity"),
    )
    return rows.where(F.col("updated_at") >= since)


def release_items(spark: SparkSession, path: str, category: str = "product") -> DataFrame:
    """(title, description, link, published_at) of a vendor's news items of one category, written in any case; those without a title are left out."""
    i = spark.read.format("xml").option("rowTag", "item").schema("title string, description string, link string, category string, pubDate string").load(path)
    when = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
    rows = i.where((F.lower(F.trim("category")) == category) & (F.trim("title") != ""))
    return rows.select(F.trim("title").alias("title"), F.trim(F.coalesce("description", F.lit(""))).alias("description"), F.trim("link").alias("link"), when.alias("published_at"))


def model_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a models API, whose lists are called ``data`` (id) or ``models`` (name)."""
    m = pages(spark, path, "data array<struct<id:string>>, models array<struct<name:string>>")
    return m.select(F.explode(F.concat(F.coalesce("data.id", F.array().cast("array<string>")), F.coalesce("models.name", F.array().cast("array<string>")))).alias("model_id")).where("model_id <> ''").distinct()


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of registry files in plain YAML: a list of flat maps, where a map may hold one nested block, whose keys come with its name.

    A file holds one registry or, as a YAML stream, several documents with lines of three dashes between them; each document is small and read as a row of its own,
    and a long file in several tasks. All are parsed by the same expressions, none on the driver.
    """
    documents = spark.read.option("lineSep", "\n---\n").text(path)
    entries = documents.select(F.explode(F.slice(F.split("value", r"(?m)^\s*- "), 2, 1 << 30)).alias("entry"))
    lines = F.filter(F.split("entry", "\n"), lambda x: F.trim(x) != "")
    # a nested key's indentation is deeper than that of the entry's own keys, which is four spaces in these files
    block = F.regexp_extract("entry", r"(?m)^ {4}([A-Za-z_]+):[ ]*$", 1)
    pair = lambda x: F.struct(
        F.concat(F.when(x.startswith(" " * 6), F.concat(block, F.lit("."))).otherwise(""), F.trim(F.substring_index(x, ":", 1))).alias("key"),
        F.regexp_extract(x, r"^[^:]*: *[\"']?(.*?)[\"']? *$", 1).alias("value"),
    )
    return entries.select(F.map_from_entries(F.filter(F.transform(lines, pair), lambda p: p["value"] != "")).alias("entry"))


def pairwise(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, delta, lo, hi, p, winner) of a ledger of compared pairs, a JSON array in a file; a pair without two names is no record."""
    rows = spark.read.schema("a string, b string, delta double, lo double, hi double, holm_p double, winner string").option("multiLine", True).json(path)
    return rows.where("a is not null and b is not null").withColumnRenamed("holm_p", "p")


def last_run(spark: SparkSession, path: str) -> DataFrame:
    """Scores of the latest run in a leaderboard's ledger."""
    ledger = spark.read.schema("runs array<struct<run_id:string,finished_at:string,scores:array<struct<name:string,score:double>>>>").option("multiLine", True).json(path)
    runs = ledger.select(F.explode("runs").alias("r")).select("r.*")
    latest = runs.groupBy().agg(F.max(F.struct("finished_at", "run_id", "scores")).alias("r")).select("r.*")
    return latest.select("run_id", F.explode("scores").alias("s")).select("run_id", "s.name", "s.score")
