"""Queries over rumour claims and the leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import lexicons as lex
from pulsegrid.functions import text
from pulsegrid.operators import leaderboard, rumors, series
from pulsegrid.plans.claims import components_sql
from pulsegrid.plans.views import ago, pick, posts, read, with_posts
from pulsegrid.shared import cut

PLATFORMS = ["twitter", "reddit", "bluesky", "web", "github"]
LAST = "1998-11-01"
#: Talk of rumours, releases and neither.
TALK = ["spotted in the arena", "nothing of note", "now available to everyone", "delayed again", "plain talk"]


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims from the first line items of orders."""
    return claims_from(read(spark, folder, "lineitem").where("l_linenumber = 1"))


def claims_from(li: DataFrame, *more: str) -> DataFrame:
    """Claims from line items, each with ``more`` columns of its own."""
    o, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        o.alias("id"), F.concat(F.lit("f"), (o % 4).cast("string")).alias("family"), F.concat(F.lit("Model-"), (p % 400).cast("string")).alias("label"),
        F.when(o % 40 < 4, F.concat(F.lit("code "), (p * 7 % 300).cast("string"))).alias("codename"), 
        F.when(o % 5 == 0, F.concat(F.lit("https://x.com/h"), s % 37, F.lit("/status/"), o)).when(o % 5 == 2, F.concat(F.lit("https://bsky.app/profile/h"), s % 37, F.lit("/post/"), o)).otherwise(F.concat(F.lit("https://site"), o % 50, F.lit(".org/"), o)).alias("url"),
        F.when(o % 15 < 5, (o - o % 5 - 5 * (o % 3)).cast("string")).alias("quoted"), pick(PLATFORMS, o % 5).alias("platform"), F.concat(F.lit("h"), (s % 37).cast("string")).alias("handle"),
        pick(rumors.PRECEDENCE, p % 6).alias("claim_type"), (o % 11 == 0).alias("credible"), F.col("l_shipdate").cast("timestamp").alias("posted_at"), *more,
    )


TOKENS_SQL = "list_distinct(list_filter([platform || ':account:' || handle, platform || ':post:' || own_id, 'twitter:post:' || quoted, CASE WHEN platform = 'web' THEN 'web:domain:' || regexp_extract(url, '//([^/]*)', 1) END], lambda t: t IS NOT NULL))"
CLAIMS_SQL = f"""claims AS (SELECT l_orderkey AS id, 'f' || (l_orderkey % 4) AS family, 'Model-' || (l_partkey % 400) AS label, CASE WHEN l_orderkey % 40 < 4 THEN 'code ' || (l_partkey * 7 % 300) END AS codename, 
  CASE l_orderkey % 5 WHEN 0 THEN 'https://x.com/h' || (l_suppkey % 37) || '/status/' || l_orderkey WHEN 2 THEN 'https://bsky.app/profile/h' || (l_suppkey % 37) || '/post/' || l_orderkey ELSE 'https://site' || (l_orderkey % 50) || '.org/' || l_orderkey END AS url,
  CASE WHEN l_orderkey % 5 IN (0, 2) THEN l_orderkey::VARCHAR END AS own_id, CASE WHEN l_orderkey % 15 < 5 THEN (l_orderkey - l_orderkey % 5 - 5 * (l_orderkey % 3))::VARCHAR END AS quoted, {str(PLATFORMS)}[l_orderkey % 5 + 1] AS platform, 'h' || (l_suppkey % 37) AS handle, {str(rumors.PRECEDENCE)}[l_partkey % 6 + 1] AS claim_type,
  l_orderkey % 11 = 0 AS credible, l_shipdate AS posted_at FROM lineitem WHERE l_linenumber = 1),
ids AS (SELECT DISTINCT family, label, codename FROM claims),
reach AS (SELECT family, label, label AS other FROM ids UNION SELECT r.family, r.label, b.label FROM reach r JOIN ids a ON a.family = r.family AND a.label = r.other JOIN ids b ON b.family = a.family AND b.codename = a.codename),
told AS (SELECT family, label AS other, max(codename) IS NULL AS bare FROM ids GROUP BY ALL),
keyed AS (SELECT family, label, arg_min(other, (bare, length(other), other)) AS cluster_key FROM reach JOIN told USING (family, other) GROUP BY family, label),
clustered AS (SELECT c.*, k.cluster_key FROM claims c JOIN keyed k USING (family, label)),
fresh AS (SELECT * FROM clustered c WHERE NOT EXISTS (SELECT 1 FROM clustered d WHERE d.family = c.family AND d.cluster_key = c.cluster_key AND d.own_id = c.quoted)),
spoken AS (SELECT *, family || '|' || cluster_key AS scope_key, {TOKENS_SQL} AS tokens FROM fresh), {components_sql('spoken', 'scope_key', 'tokens', 'origin')},
rooted AS (SELECT s.*, o.root FROM spoken s JOIN origin o ON o.scope = s.scope_key AND o.n = s.tokens[1]),
products AS (SELECT family, cluster_key, count(DISTINCT root) AS mention_count, list_sort(list(DISTINCT platform)) AS pl, arg_min(claim_type, (list_position({str(rumors.PRECEDENCE)}, claim_type), -epoch(posted_at))) AS claim_type,
  min(posted_at) AS first_seen_at, max(posted_at) AS last_seen_at, bool_or(credible) AS has_credible_source FROM rooted GROUP BY family, cluster_key)"""
EVERY_SQL = CLAIMS_SQL.replace("AS tokens FROM fresh)", "AS tokens FROM clustered)")


def clustered(spark: SparkSession, folder: str) -> DataFrame:
    return cut(rumors.clusters(claims(spark, folder)), "clustered")


def cluster_products(spark: SparkSession, folder: str) -> DataFrame:
    return clustered(spark, folder).select("id", "family", "cluster_key")


def quote_echo_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return rumors.without_echoes(clustered(spark, folder)).select("id", "cluster_key")


def flat(products: DataFrame) -> DataFrame:
    return products.withColumn("platforms", F.concat_ws(",", "platforms"))


def rumor_accumulate(spark: SparkSession, folder: str) -> DataFrame:
    return flat(rumors.accumulate(rumors.without_echoes(clustered(spark, folder))))


def rumor_absorb(spark: SparkSession, folder: str) -> DataFrame:
    """Products of earlier claims, then later ones merged in."""
    c = clustered(spark, folder)
    early = F.col("posted_at") < F.lit("1996-01-01").cast("timestamp")
    links = rumors.origin_links(c.where(early)).union(rumors.origin_links(c.where(~early))).distinct()
    return flat(rumors.absorb(rumors.accumulate(c.where(early)), rumors.accumulate(c.where(~early)), links))


def rumor_board(spark: SparkSession, folder: str) -> DataFrame:
    """Products not known to be released; of some it isn't known."""
    products = rumors.accumulate(rumors.without_echoes(clustered(spark, folder)))
    products = products.withColumn("is_released", F.when(F.col("cluster_key").endswith("7"), True).when(~F.col("cluster_key").endswith("3"), False))
    return flat(rumors.board(products, F.lit(LAST).cast("timestamp"), 21)).select("family", "cluster_key", "mention_count", "platforms", "claim_type")


def rumor_sources(spark: SparkSession, folder: str) -> DataFrame:
    return rumors.top_sources(clustered(spark, folder))


def rumor_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Of the newest thousand posts of ten days that weren't looked at and speak of rumours or releases the newest of each URL, of these the newest two hundred."""
    p, i = posts(spark, folder), F.col("id")
    said = F.concat_ws(" ", "title", pick(TALK, i % len(TALK)))
    match = p.where((i % 9 != 0) & (F.col("posted_at") >= ago(days=10)) & F.col("source_url").isNotNull() & (text.is_rumor(said) | text.has(said, lex.RELEASED)))
    newest = match.orderBy(F.desc("posted_at"), F.desc("id")).limit(1000)
    each = series.latest(newest, ["source_url"], "posted_at", 1, "id")
    return each.orderBy(F.desc("posted_at"), F.desc("id")).limit(200).select("id", "source_url", "posted_at")


def board(spark: SparkSession, folder: str) -> DataFrame:
    """A leaderboard from parts."""
    p, k = read(spark, folder, "part"), F.col("p_partkey")
    return p.select(
        F.concat(F.lit("n"), k.cast("string")).alias("name"), F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" Pro "), (k % 7 + 1).cast("string"), F.lit("."), (F.col("p_size") % 5).cast("string")).alias("label"), (k % 10 != 0).alias("ranked"),
        F.col("p_retailprice").alias("score"), (F.col("p_retailprice") - F.col("p_size")).alias("lo"), (F.col("p_retailprice") + F.col("p_size")).alias("hi"), F.col("p_brand").alias("brand"),
        F.concat(F.lit("2026-07-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("price_date"), (F.col("p_size") * 1.0).alias("price"), k.alias("k"),
    )


BOARD_SQL = """board AS (SELECT 'n' || p_partkey AS name, replace(p_brand, '#', '') || ' Pro ' || (p_partkey % 7 + 1) || '.' || (p_size % 5) AS label, p_partkey % 10 <> 0 AS ranked, p_retailprice AS score, p_retailprice - p_size AS lo, p_retailprice + p_size AS hi, p_brand AS brand,
  '2026-07-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS price_date, p_size * 1.0::DOUBLE AS price, p_partkey AS k, lower(replace(p_brand, '#', '')) || ' pro' AS fam, [(p_partkey % 7 + 1)::INTEGER, (p_size % 5)::INTEGER] AS ver FROM part)"""


def board_lineup(spark: SparkSession, folder: str) -> DataFrame:
    return leaderboard.successors(board(spark, folder)).select("name", "successor")


def leader_band(spark: SparkSession, folder: str) -> DataFrame:
    return leaderboard.leading_band(board(spark, folder), "brand")


def generation_deltas(spark: SparkSession, folder: str) -> DataFrame:
    b = board(spark, folder)
    d = (F.col("score") % 100 - 50) / 1000
    other = F.concat(F.lit("n"), (F.col("k") + 1).cast("string"))
    odd = F.col("k") % 2 == 1
    pairs = b.select(F.when(odd, F.col("name")).otherwise(other).alias("a"), F.when(odd, other).otherwise(F.col("name")).alias("b"), d.alias("delta"), (d - 0.01).alias("lo"), (d + 0.01).alias("hi"), F.when(F.abs(d) > 0.03, F.when(odd == (d > 0), F.col("name")).otherwise(other)).alias("winner"))
    wanted = b.select(F.col("name").alias("previous"), other.alias("current")).where(F.col("k") % 3 != 0)
    return leaderboard.verdicts(pairs, wanted)


DELTA_SQL = f"""WITH {BOARD_SQL}, q AS (SELECT name, 'n' || (k + 1) AS other, k % 2 = 1 AS odd, (score % 100 - 50) / 1000 AS d FROM board WHERE k % 3 <> 0),
r AS (SELECT name AS previous, other AS current, CASE WHEN odd THEN -d ELSE d END AS delta, CASE WHEN odd THEN -(d + 0.01::DOUBLE) ELSE d - 0.01::DOUBLE END AS lo, CASE WHEN odd THEN -(d - 0.01::DOUBLE) ELSE d + 0.01::DOUBLE END AS hi, CASE WHEN abs(d) > 0.03 THEN CASE WHEN odd = (d > 0) THEN name ELSE other END END AS winner FROM q)
SELECT previous, current, round(100 * delta, 6) AS delta_points, round(100 * lo, 6) AS lo_points, round(100 * hi, 6) AS hi_points, CASE WHEN winner = current THEN 'decisive-up' WHEN winner = previous THEN 'decisive-down' WHEN lo > 0 THEN 'suggestive-up' WHEN hi < 0 THEN 'suggestive-down' WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'even' END AS verdict FROM r"""


def scoring_dates(spark: SparkSession, folder: str) -> DataFrame:
    return leaderboard.scoring_dates(board(spark, folder).where("ranked"), "2026-07-10")


def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    b = board(spark, folder)
    after = b.where("k % 9 <> 0").select("name", F.when(F.col("k") % 5 == 0, F.col("score") + 1).otherwise(F.col("score")).alias("score"), F.when(F.col("k") % 4 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"))
    return leaderboard.changes(b.where("k % 8 <> 0"), after)


def board_meta(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs a board of each brand has, and how many records are decisive."""
    b = board(spark, folder).where("ranked").groupBy("brand").agg(F.count(F.lit(1)).alias("n_models"), F.count_if(F.abs((F.col("score") % 100 - 50) / 1000) > 0.03).alias("n_decisive"))
    return b.withColumn("n_pairs", (F.col("n_models") * (F.col("n_models") - 1) / 2).cast("long"))


def label_squash(spark: SparkSession, folder: str) -> DataFrame:
    return board(spark, folder).select("name", text.squash(F.col("label")).alias("key"), leaderboard.family(F.col("label")).alias("family"))


QUERIES = {
    "cluster_products": cluster_products,
    "quote_echo_collapse": quote_echo_collapse,
    "rumor_accumulate": rumor_accumulate,
    "rumor_absorb": rumor_absorb,
    "rumor_board": rumor_board,
    "rumor_sources": rumor_sources,
    "rumor_candidates": rumor_candidates,
    "board_lineup": board_lineup,
    "leader_band": leader_band,
    "generation_deltas": generation_deltas,
    "scoring_dates": scoring_dates,
    "snapshot_diff": snapshot_diff,
    "board_meta": board_meta,
    "label_squash": label_squash,
}
_C = f"WITH RECURSIVE {CLAIMS_SQL} "
_PL = "array_to_string(pl, ',') AS platforms"
_B = f"WITH {BOARD_SQL} "
ORACLE = {
    "cluster_products": _C + "SELECT id, family, cluster_key FROM clustered",
    "quote_echo_collapse": _C + "SELECT id, cluster_key FROM fresh",
    "rumor_accumulate": _C + f"SELECT * EXCLUDE (pl), {_PL} FROM products",
    "rumor_absorb": f"WITH RECURSIVE {EVERY_SQL} SELECT family, cluster_key, count(DISTINCT root) AS mention_count, array_to_string(list_sort(list(DISTINCT platform)), ',') AS platforms, arg_min(claim_type, list_position({rumors.PRECEDENCE}, claim_type)) AS claim_type, min(posted_at) AS first_seen_at, max(posted_at) AS last_seen_at, bool_or(credible) AS has_credible_source FROM rooted GROUP BY family, cluster_key",
    "rumor_board": _C + f"SELECT family, cluster_key, mention_count, {_PL}, claim_type FROM products WHERE (mention_count >= 2 OR has_credible_source) AND last_seen_at >= TIMESTAMP '{LAST}' - INTERVAL 21 DAY AND NOT ends_with(cluster_key, '7') ORDER BY has_credible_source DESC, len(pl) DESC, mention_count DESC, last_seen_at DESC, family, cluster_key LIMIT 100",
    "rumor_sources": _C + "SELECT family, cluster_key, string_agg(url, ',' ORDER BY posted_at DESC, url) AS sources FROM (SELECT family, cluster_key, url, max(posted_at) AS posted_at FROM clustered GROUP BY family, cluster_key, url QUALIFY row_number() OVER (PARTITION BY family, cluster_key ORDER BY max(posted_at) DESC, url) <= 4) GROUP BY family, cluster_key",
    "rumor_candidates": with_posts("SELECT id, source_url, posted_at FROM (SELECT * FROM (SELECT * FROM posts WHERE id % 9 <> 0 AND posted_at >= TIMESTAMP '2024-01-21' AND id % 5 NOT IN (1, 4) ORDER BY posted_at DESC, id DESC LIMIT 1000) QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY posted_at DESC, id DESC) = 1) ORDER BY posted_at DESC, id DESC LIMIT 200"),
    "board_lineup": _B + ", t AS (SELECT fam, max(ver) AS tv, arg_max(name, (ver, name)) AS tn FROM board WHERE ranked GROUP BY fam) SELECT name, CASE WHEN tv > ver AND tn <> name THEN tn END AS successor FROM board LEFT JOIN t USING (fam)",
    "leader_band": _B + ", l AS (SELECT brand, name, score, hi >= first(lo) OVER w AS r, row_number() OVER w AS i FROM board WINDOW w AS (PARTITION BY brand ORDER BY score DESC, name)), f AS (SELECT brand, coalesce(min(i) FILTER (WHERE NOT r), 1000000000) AS cutoff FROM l GROUP BY brand), b AS (SELECT l.* FROM l JOIN f USING (brand) WHERE i < cutoff) SELECT brand, name, score FROM b QUALIFY count(*) OVER (PARTITION BY brand) > 1",
    "generation_deltas": DELTA_SQL,
    "scoring_dates": _B + "SELECT scored_on, count(*) AS n, array_to_string(list(name ORDER BY score DESC, name)[1:5], ',') AS top_names FROM (SELECT *, greatest(price_date, '2026-07-10') AS scored_on FROM board WHERE ranked) GROUP BY scored_on",
    "snapshot_diff": _B + "SELECT * FROM (SELECT name, CASE WHEN o.score IS NULL THEN 'added' WHEN n.score IS NULL THEN 'removed' WHEN o.score <> n.score THEN 'rescored' WHEN o.price <> n.price THEN 'repriced' END AS change, o.score AS old_score, n.score AS new_score FROM (SELECT * FROM board WHERE k % 8 <> 0) o FULL JOIN (SELECT name, CASE WHEN k % 5 = 0 THEN score + 1 ELSE score END AS score, CASE WHEN k % 4 = 0 THEN price + 1 ELSE price END AS price FROM board WHERE k % 9 <> 0) n USING (name)) WHERE change IS NOT NULL",
    "board_meta": _B + "SELECT brand, count(*) AS n_models, count(*) FILTER (WHERE abs((score % 100 - 50) / 1000) > 0.03) AS n_decisive, (count(*) * (count(*) - 1) / 2)::BIGINT AS n_pairs FROM board WHERE ranked GROUP BY brand",
    "label_squash": _B + "SELECT name, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS key, trim(regexp_replace(fam, '[\\s-]+', ' ', 'g')) AS family FROM board",
}
