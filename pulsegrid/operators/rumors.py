"""Rumour claims to products: identities to clusters, echoes, accumulation, gates and order of the board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import text
from pulsegrid.operators import canon
from pulsegrid.operators.graph import connected_components
from pulsegrid.shared import cut

#: Lifecycle claims by precedence, strongest first.
PRECEDENCE = ["delayed", "return", "imminent", "in_testing", "launch", "other"]


def clusters(claims: DataFrame) -> DataFrame:
    """Add ``cluster_key``: claims of a family that share a label or a codename, directly or through others, are one product.

    Identities, not claims, are the nodes: claims collapse to their distinct (family, label, codename), so a product that a third
    of all claims speak of is a few edges. The key is the label of the identity that says most, one with a codename before one
    without, and of these the shortest. A name without letters or digits is none; claims that have no
    name at all are about no product and are left out.
    """
    names = ["family", "label", "codename"]
    own, code = (F.concat("family", F.lit(kind), F.nullif(text.squash(F.col(c)), F.lit(""))) for c, kind in (("label", ":l:"), ("codename", ":c:")))
    said = cut(claims.select(*names).distinct().withColumn("_l", own).withColumn("_c", code).where("_l is not null or _c is not null"), "identities")
    roots = connected_components(said.where("_l is not null and _c is not null").select(F.col("_l").alias("a"), F.col("_c").alias("b")))
    rooted = said.withColumn("_t", F.coalesce("_l", "_c")).join(roots, F.col("_t") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_t"))
    best = rooted.groupBy("_root").agg(F.min(F.when(F.col("_l").isNotNull(), F.struct(F.col("_c").isNull(), F.length("label"), "label")))["label"].alias("best_label"), F.min(F.when(F.col("_c").isNotNull(), F.col("codename"))).alias("best_codename"))
    keys = rooted.join(best, "_root").select(*(F.col(c).alias(f"_{c}") for c in names), F.coalesce("best_label", "best_codename").alias("cluster_key"))
    same = F.col("family").eqNullSafe(F.col("_family")) & F.col("label").eqNullSafe(F.col("_label")) & F.col("codename").eqNullSafe(F.col("_codename"))
    return claims.join(keys, same).drop(*(f"_{c}" for c in names))


def without_echoes(claims: DataFrame) -> DataFrame:
    """Without claims that quote a post, by its id, which itself is a claim of their cluster: its URL holds that id."""
    own = claims.select("family", "cluster_key", canon.status_id(F.col("url")).alias("quoted")).where("quoted is not null").distinct()
    return claims.join(own, ["family", "cluster_key", "quoted"], "left_anti")


def precedence(claim_type: Column) -> Column:
    out = F.lit(len(PRECEDENCE))
    for i, name in reversed(list(enumerate(PRECEDENCE))):
        out = F.when(claim_type == name, i).otherwise(out)
    return out


PRODUCT = ["family", "cluster_key"]


def source_tokens() -> Column:
    return canon.origin_tokens(F.col("platform"), F.col("handle"), F.col("url"), F.col("quoted"))


def origin_links(claims: DataFrame) -> DataFrame:
    """(family, cluster_key, a, b): by what the claims' sources belong together, within a product. Links of later claims are simply added."""
    return canon.token_links(claims, source_tokens(), PRODUCT)


def origin_counts(links: DataFrame) -> DataFrame:
    """(family, cluster_key, mention_count): how many independent origins the links leave."""
    named = lambda c: F.concat_ws("|", *PRODUCT, c)
    links = cut(links, "origin-links")
    roots = connected_components(links.where("a <> b").select(named("a").alias("a"), named("b").alias("b")))
    ends = links.select(*PRODUCT, named("a").alias("node")).distinct().join(roots, "node", "left")
    return ends.groupBy(*PRODUCT).agg(F.count_distinct(F.coalesce("root", "node")).alias("mention_count"))


def accumulate(claims: DataFrame) -> DataFrame:
    """One row for each product: independent origins (accounts, quoted posts and domains tie sources together), platforms, lead claim, span, credibility."""
    claims = cut(claims.select(*PRODUCT, "platform", "handle", "url", "quoted", "claim_type", "posted_at", "credible"), "accumulated")
    lead = F.min(F.struct(precedence(F.col("claim_type")).alias("p"), (-F.col("posted_at").cast("long")).alias("t"), "claim_type"))["claim_type"]
    rest = claims.groupBy(*PRODUCT).agg(
        F.array_sort(F.collect_set("platform")).alias("platforms"), lead.alias("claim_type"),
        F.min("posted_at").alias("first_seen_at"), F.max("posted_at").alias("last_seen_at"), F.bool_or("credible").alias("has_credible_source"),
    )
    return rest.join(origin_counts(origin_links(claims)), PRODUCT).select(*PRODUCT, "mention_count", *(c for c in rest.columns if c not in PRODUCT))


def absorb(stored: DataFrame, new: DataFrame, links: DataFrame) -> DataFrame:
    """Merge newly accumulated products into stored ones: origins are those of all ``links``, stored and new; platforms unite, the stronger claim leads."""
    n = new.select(*PRODUCT, *(F.col(c).alias(f"n_{c}") for c in ("platforms", "claim_type", "first_seen_at", "last_seen_at", "has_credible_source")))
    both = stored.drop("mention_count").join(n, PRODUCT, "full_outer").join(origin_counts(links), PRODUCT, "left")
    empty = F.array().cast("array<string>")
    stronger = precedence(F.col("n_claim_type")) <= precedence(F.col("claim_type"))
    return both.select(
        *PRODUCT, F.coalesce("mention_count", F.lit(0)).alias("mention_count"),
        F.array_sort(F.array_union(F.coalesce("platforms", empty), F.coalesce("n_platforms", empty))).alias("platforms"),
        F.when(F.col("claim_type").isNull() | (F.col("n_claim_type").isNotNull() & stronger), F.col("n_claim_type")).otherwise(F.col("claim_type")).alias("claim_type"),
        F.least("first_seen_at", "n_first_seen_at").alias("first_seen_at"), F.greatest("last_seen_at", "n_last_seen_at").alias("last_seen_at"),
        (F.coalesce("has_credible_source", F.lit(False)) | F.coalesce("n_has_credible_source", F.lit(False))).alias("has_credible_source"),
    )


def board(products: DataFrame, now: Column, days: int, limit: int = 100) -> DataFrame:
    """Products with enough evidence, seen lately and not known to be released (``is_released`` null or false): the most credible and most widely reported first."""
    open_ = ~F.coalesce("is_released", F.lit(False)) & ((F.col("mention_count") >= 2) | F.col("has_credible_source")) & (F.col("last_seen_at") >= now - F.make_dt_interval(days=F.lit(days)))
    return products.where(open_).orderBy(F.desc("has_credible_source"), F.desc(F.size("platforms")), F.desc("mention_count"), F.desc("last_seen_at"), "family", "cluster_key").limit(limit)


def top_sources(claims: DataFrame, n: int = 4) -> DataFrame:
    """The latest n distinct URLs of each product, in order."""
    latest = claims.groupBy("family", "cluster_key", "url").agg(F.max("posted_at").alias("posted_at"))
    order = Window.partitionBy("family", "cluster_key").orderBy(F.desc("posted_at"), "url")
    top = latest.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    return top.groupBy("family", "cluster_key").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_r", "url"))), lambda x: x["url"])).alias("sources"))


MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def eta(said: Column, seen: Column) -> Column:
    """A time that a text gives, as the first day it can mean: a quarter, a month, next week or month, or a date."""
    low = F.lower(said)
    quarter = F.regexp_extract(low, r"q([1-4])\s*(20\d\d)", 1), F.regexp_extract(low, r"q([1-4])\s*(20\d\d)", 2)
    month = F.regexp_extract(low, f"({'|'.join(MONTHS)})", 1)
    year = F.regexp_extract(low, r"(20\d\d)", 1)
    place = F.array_position(F.array(*map(F.lit, MONTHS)), month).cast("int")
    year = F.when(year != "", year.cast("int")).otherwise(F.when(place < F.month(seen), F.year(seen) + 1).otherwise(F.year(seen)))
    first = F.when(low.contains("mid"), 11).when(low.contains("late"), 21).otherwise(1)
    return (
        F.when(low.rlike(r"20\d\d-\d\d-\d\d"), F.to_date(F.regexp_extract(low, r"(20\d\d-\d\d-\d\d)", 1)))
        .when(quarter[0] != "", F.make_date(F.nullif(quarter[1], F.lit("")).cast("int"), (F.nullif(quarter[0], F.lit("")).cast("int") - 1) * 3 + 1, F.lit(1)))
        .when(month != "", F.make_date(year, place, first))
        .when(low.contains("next week"), F.date_add(F.to_date(F.date_trunc("week", seen)), 7))
        .when(low.contains("this week"), F.to_date(F.date_trunc("week", seen)))
        .when(low.contains("next month"), F.add_months(F.to_date(F.date_trunc("month", seen)), 1))
        .when(low.contains("this month"), F.to_date(F.date_trunc("month", seen)))
    )


def with_eta(rows: DataFrame, said: str, seen: str) -> DataFrame:
    """Add ``eta``, a time that a text gives, in words: a week, a last day, part of a month, a month, a quarter or a day, counted from when it was seen."""
    names = "(" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + ")"
    full = rf"\b{names}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s*(\d{{4}}))?"
    some, only, quarter = rf"\b(early|mid|late)[-\s]+{names}\b", rf"\b(in|into|during|through)\s+{names}\b", r"\bq([1-4])(?:\s*(\d{4}))?\b"
    raw = F.nullif(F.trim(F.regexp_replace(said, r"\s+", " ")), F.lit(""))
    low, on = F.col("_low"), F.col("_on")
    part = lambda pattern, i: F.nullif(F.regexp_extract(low, pattern, i), F.lit(""))
    number = lambda name: F.nullif(F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.substring(name, 1, 3)), F.lit(0)).cast("int")
    out = rows.select("*", raw.alias("_raw"), F.lower(raw).alias("_low"), F.to_date(seen).alias("_on"))
    out = out.select(
        "*", number(part(full, 1)).alias("_m"), part(full, 2).cast("int").alias("_d"), part(full, 3).cast("int").alias("_y"), part(some, 1).alias("_part"), number(part(some, 2)).alias("_pm"),
        number(part(only, 2)).alias("_om"), part(quarter, 1).alias("_q"), F.coalesce(part(quarter, 2), F.year(on).cast("string")).alias("_qy"),
    )
    # a month without a year that has gone by is next year's
    first = lambda m, y: F.make_date(F.coalesce(y, F.year(on) + (F.col(m) < F.month(on)).cast("int")), F.col(m), F.lit(1))
    none = F.lit(None).cast("int")
    out = out.select("*", F.date_add(first("_m", F.col("_y")), F.col("_d") - 1).alias("_day"), first("_pm", none).alias("_pday"), first("_om", none).alias("_oday"))
    day_of = lambda d: F.concat(F.date_format(d, "MMM "), F.dayofmonth(d), F.lit(", "), F.year(d))
    month_of = lambda d: F.date_format(d, "MMMM yyyy")
    week = lambda d: F.to_date(F.date_trunc("week", d))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("_raw", "^~+", ""), r"(?i)^(?:new\s+)?target(?:\s+is)?\s+", ""), r"(?i)^expected\s+", ""))
    day = F.col("_day")
    label = (
        F.when(low.contains("week of") & day.isNotNull(), F.concat(F.lit("Week of "), day_of(day)))
        .when(low.rlike(r"\bby\b") & day.isNotNull(), F.concat(F.lit("By "), day_of(day)))
        .when(F.col("_pday").isNotNull(), F.concat(F.initcap("_part"), F.lit("-"), month_of(F.col("_pday"))))
        .when(F.col("_oday").isNotNull(), month_of(F.col("_oday")))
        .when(F.col("_q").isNotNull(), F.concat(F.lit("Q"), "_q", F.lit(" "), "_qy"))
        .when(low.contains("next week"), F.concat(F.when(low.contains("as early as"), "As early as the week of ").otherwise("Week of "), day_of(week(F.date_add(on, 7)))))
        .when(low.contains("this week"), F.concat(F.lit("Week of "), day_of(week(on))))
        .when(low.contains("next month"), month_of(F.add_months(F.date_trunc("month", on), 1)))
        .when(low.contains("this month"), month_of(on))
        .when(day.isNotNull(), day_of(day))
        .when(plain == "", F.col("_raw"))
        .otherwise(F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, F.lit(2), F.length(plain))))
    )
    return out.select(*rows.columns, label.alias("eta"))
