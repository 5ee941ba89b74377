"""Queries over texts: filters, attribution, surfaces, markup and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import lexicons as lex
from pulsegrid.functions import taxonomy, text
from pulsegrid.functions.taxonomy import complaint_sql
from pulsegrid.operators import breakdowns
from pulsegrid.operators.attribution import Keyword, models_of, models_of_sql
from pulsegrid.operators.scoring import half_up
from pulsegrid.plans.views import MODELS, ago, models, posts, read, with_posts

KEYWORDS = [
    Keyword("claude", "claude"),
    Keyword("claude", "sonnet", "ambiguous", ("anthropic", "model")),
    Keyword("chatgpt", "chatgpt"),
    Keyword("chatgpt", "gpt-5"),
    Keyword("chatgpt", "gpt", "ambiguous"),
    Keyword("chatgpt", "openai", "ambiguous"),
    Keyword("gemini", "gemini", "ambiguous", ("google", "model", "ai")),
    Keyword("grok", "grok"),
]
SAMPLES = [
    (1, "I switched to Claude last week and my code reviews got faster"),
    (2, "OpenAI announces new integration https://example.com/x for teams everywhere"),
    (3, "Tech Daily: Gemini model gains new reasoning skills in tests https://example.com/y"),
    (4, "look https://example.com/z"),
    (5, "ChatGPT lost at chess against an Atari console from 1979"),
    (6, "Leaked model string hints at Grok arriving next week"),
    (7, "GPT-5 is now available to everyone, starting today"),
    (8, "Limited preview of gemini ai for enterprise partners for testing"),
    (9, "General availability after our limited preview of claude"),
    (10, "Sign up for our newsletter about gpt agents"),
    (11, "running gpt-oss 20b on ollama in my home lab, works"),
    (12, "a sonnet by Shakespeare"),
    (13, "the sonnet model by anthropic refuses too much, we tested it"),
    (14, "short"),
    (15, "Claude Code keeps deleting files - The Verge"),
    (16, "sponsored: the best prompts for openai api users"),
    (17, "<p>I used <b>gpt 5</b> today</p> and it was fine"),
    (18, "ÉCLAUDE is not a model but claude is"),
]
MARKERS = ["claude code", "claude.ai", "anthropic api", "codex", "chatgpt app", "openai api", "gemini cli", "ai studio", "grok app", "anthropic-sdk", ""]


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


MENTIONS_SQL = f"mentions AS (SELECT * FROM (VALUES {', '.join(f'({i}, {sql_text(t)})' for i, t in SAMPLES)}) v(id, text) UNION ALL SELECT 1000 + doc_id, coalesce(text, '') FROM documents)"


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Example texts and all documents."""
    samples = spark.createDataFrame(SAMPLES, "id long, text string")
    return samples.union(read(spark, folder, "documents").select(F.col("doc_id") + 1000, F.coalesce("text", F.lit(""))))


def text_min_length(spark: SparkSession, folder: str) -> DataFrame:
    return mentions(spark, folder).select("id", text.long_enough(F.col("text")).alias("long_enough"))


def nonexperience_filter(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    rows = mentions(spark, folder).select("id", text.is_news(t).alias("news"), text.is_promotion(t).alias("promotion"), text.is_novelty(t).alias("novelty"), text.has_experience(t).alias("experience"))
    return rows.withColumn("nonexperience", F.col("news") | F.col("promotion") | F.col("novelty"))


def rumor_lexicon_match(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    drop = text.is_news(t) | text.is_promotion(t) | text.is_novelty(t)
    rows = mentions(spark, folder).select("id", text.is_rumor(t).alias("rumor"), text.is_release(t).alias("release"), drop.alias("_drop"))
    return rows.select("id", "rumor", "release", (~F.col("_drop") | F.col("rumor") | F.col("release")).alias("keep"))


def keyword_attribution(spark: SparkSession, folder: str) -> DataFrame:
    found = mentions(spark, folder).select("id", models_of(F.col("text"), KEYWORDS).alias("slugs"))
    return found.where(F.size("slugs") > 0).select("id", F.concat_ws(",", "slugs").alias("slugs"))


def attributed_posts(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each (text, model)."""
    found = mentions(spark, folder).select("id", F.explode(models_of(F.col("text"), KEYWORDS)).alias("slug"))
    return found.join(F.broadcast(models(spark)), "slug").select("id", "model_id", "slug")


def html_strip(spark: SparkSession, folder: str) -> DataFrame:
    plain = text.plain_html(F.coalesce("html", F.lit("")))
    return read(spark, folder, "pages").select("page_id", F.length(plain).cast("long").alias("n_chars"), F.md5(plain).alias("text_md5"))


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("url")
    return read(spark, folder, "pages").select("page_id", text.host(u).alias("host"), F.regexp_extract(u, r"^[a-z]+://[^/?#]*/([^/?#]*)", 1).alias("section"), F.regexp_extract(u, r"[?&]page=(\d+)", 1).alias("page"), text.safe_url(u).alias("safe_url"))


def surfaced(spark: SparkSession, folder: str) -> DataFrame:
    """Posts with the product surface that their text names."""
    marker = F.element_at(F.array(*map(F.lit, MARKERS)), (F.col("k") % len(MARKERS)).cast("int") + 1)
    rows = posts(spark, folder).join(F.broadcast(models(spark).select("model_id", "slug")), "model_id")
    return rows.withColumn("surface", text.surface(F.col("slug"), F.concat_ws(" ", "title", marker)))


SURFACED_SQL = f""", surfaced AS (SELECT p.*, slug, {text.surface_sql('slug', f"(title || ' ' || {str(MARKERS)}[k % {len(MARKERS)} + 1])")} AS surface FROM posts p JOIN models USING (model_id))"""


def surface_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Day, model and surface: counts, a score with neutral at 0.3, the most frequent complaint; thin cells are left out."""
    fine = (F.col("status") == "classified") & (F.col("confidence") >= 0.65)
    rows = surfaced(spark, folder).where(F.col("surface").isNotNull()).withColumn("day", F.date_format("posted_at", "yyyy-MM-dd"))
    key = ["day", "slug", "surface"]
    of = lambda s: F.count_if(fine & (F.col("sentiment") == s))
    cells = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("total_posts"), of("positive").alias("positive"), of("negative").alias("negative"), of("neutral").alias("neutral"))
    eligible = F.col("positive") + F.col("negative") + F.col("neutral")
    cells = cells.where(eligible >= 5).withColumn("score", half_up(100.0 * (F.col("positive") + 0.3 * F.col("neutral")) / eligible))
    counted = rows.where(fine).withColumn("category", taxonomy.complaint(F.col("complaint"))).where("category is not null").groupBy(*key, "category").agg(F.count(F.lit(1)).alias("c"))
    top = counted.groupBy(*key).agg(F.min(F.struct((-F.col("c")).alias("o"), "category"))["category"].alias("top_complaint"))
    return cells.join(top, key, "left").withColumn("top_complaint", F.coalesce("top_complaint", F.lit("")))


KINDS = ["cli", "product_app", "api", "sdk"]


def coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    """For each model how many posts name a surface, and how many each kind of surface."""
    kind = F.lit("other")
    for patterns in lex.SURFACES.values():
        for _, name, label in patterns:
            kind = F.when(F.col("surface") == label, name).otherwise(kind)
    rows = surfaced(spark, folder)
    wide = rows.where("surface is not null").withColumn("kind", kind).groupBy("slug").pivot("kind", KINDS).count()
    total = rows.groupBy("slug").agg(F.count(F.lit(1)).alias("n_posts"), F.count("surface").alias("n_matched"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in KINDS]
    return total.join(wide, "slug", "left").select("slug", "n_posts", "n_matched", F.round(F.col("n_matched") / F.col("n_posts"), 6).alias("rate"), *filled)


def negative_surface_mix(spark: SparkSession, folder: str) -> DataFrame:
    rows = surfaced(spark, folder).where((F.col("sentiment") == "negative") & (F.col("posted_at") >= ago(days=30)))
    return breakdowns.with_pct(rows.groupBy("model_id", F.coalesce("surface", F.lit("Unspecified")).alias("surface")).agg(F.count(F.lit(1)).alias("n")), ["model_id"])


QUERIES = {
    "text_min_length": text_min_length,
    "nonexperience_filter": nonexperience_filter,
    "rumor_lexicon_match": rumor_lexicon_match,
    "keyword_attribution": keyword_attribution,
    "attributed_posts": attributed_posts,
    "html_strip": html_strip,
    "url_parts": url_parts,
    "surface_dataset": surface_dataset,
    "coverage_report": coverage_report,
    "negative_surface_mix": negative_surface_mix,
}
_F = text.flags_sql("text")
_KINDS = {label: kind for patterns in lex.SURFACES.values() for _, kind, label in patterns}
_KIND = "CASE surface " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " END"
_DAY = ["day", "slug", "surface"]
ORACLE = {
    "text_min_length": f"WITH {MENTIONS_SQL} SELECT id, {_F['long_enough']} AS long_enough FROM mentions",
    "nonexperience_filter": f"WITH {MENTIONS_SQL} SELECT *, news OR promotion OR novelty AS nonexperience FROM (SELECT id, {', '.join(f'{_F[k]} AS {k}' for k in ('news', 'promotion', 'novelty', 'experience'))} FROM mentions)",
    "rumor_lexicon_match": f"WITH {MENTIONS_SQL} SELECT id, rumor, release, NOT d OR rumor OR release AS keep FROM (SELECT id, {_F['rumor']} AS rumor, {_F['release']} AS release, {_F['news']} OR {_F['promotion']} OR {_F['novelty']} AS d FROM mentions)",
    "keyword_attribution": f"WITH {MENTIONS_SQL} SELECT id, array_to_string(s, ',') AS slugs FROM (SELECT id, {models_of_sql('text', KEYWORDS)} AS s FROM mentions) WHERE len(s) > 0",
    "attributed_posts": f"WITH {MENTIONS_SQL} SELECT id, model_id, m.slug FROM (SELECT id, unnest({models_of_sql('text', KEYWORDS)}) AS slug FROM mentions) a JOIN (VALUES {', '.join(str(m[:2]) for m in MODELS)}) m(model_id, slug) ON a.slug = m.slug",
    "html_strip": f"SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {text.plain_html_sql('coalesce(html, chr(0))').replace('chr(0)', chr(39) * 2)} AS t FROM pages)",
    "url_parts": r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]*)', 1) AS section, regexp_extract(url, '[?&]page=(\d+)', 1) AS page, CASE WHEN regexp_matches(url, '^https?://[^\s<>""'']+$') THEN url END AS safe_url FROM pages".replace('""', '"'),
    "surface_dataset": with_posts(f"""{SURFACED_SQL}, c AS (SELECT *, strftime(posted_at, '%Y-%m-%d') AS day, status = 'classified' AND confidence >= 0.65 AS fine, {complaint_sql('complaint')} AS category FROM surfaced WHERE surface IS NOT NULL),
      n AS (SELECT day, slug, surface, count(*) AS total_posts, count(*) FILTER (WHERE fine AND sentiment = 'positive') AS positive, count(*) FILTER (WHERE fine AND sentiment = 'negative') AS negative, count(*) FILTER (WHERE fine AND sentiment = 'neutral') AS neutral FROM c GROUP BY day, slug, surface),
      t AS (SELECT day, slug, surface, category FROM (SELECT day, slug, surface, category, count(*) AS k FROM c WHERE fine AND category IS NOT NULL GROUP BY day, slug, surface, category) QUALIFY row_number() OVER (PARTITION BY day, slug, surface ORDER BY k DESC, category) = 1)
      SELECT n.*, floor(round(100.0::DOUBLE * (positive + 0.3::DOUBLE * neutral) / (positive + negative + neutral), 9) + 0.5::DOUBLE)::INTEGER AS score, coalesce(t.category, '') AS top_complaint FROM n LEFT JOIN t USING (day, slug, surface) WHERE positive + negative + neutral >= 5"""),
    "coverage_report": with_posts(f"{SURFACED_SQL} SELECT slug, count(*) AS n_posts, count(surface) AS n_matched, round(count(surface) / count(*)::DOUBLE, 6) AS rate, count(*) FILTER (WHERE {_KIND} = 'cli') AS cli, count(*) FILTER (WHERE {_KIND} = 'product_app') AS product_app, count(*) FILTER (WHERE {_KIND} = 'api') AS api, count(*) FILTER (WHERE {_KIND} = 'sdk') AS sdk FROM surfaced GROUP BY slug"),
    "negative_surface_mix": with_posts(f"{SURFACED_SQL} SELECT model_id, surface, n, floor(round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY model_id), 9) + 0.5::DOUBLE)::INTEGER AS pct FROM (SELECT model_id, coalesce(surface, 'Unspecified') AS surface, count(*) AS n FROM surfaced WHERE sentiment = 'negative' AND posted_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY 1, 2)"),
}
