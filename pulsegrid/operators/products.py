"""Products accumulated from rumour claims: the claim that leads, the expected time and whether sources differ on it, sources kept by origin.

Every part of a product is a largest, a smallest, a union or a count of independent origins, so the result doesn't depend on the order or the
batches in which claims arrive; ``pulsegrid.streaming.products`` keeps the same parts as state.

Claims need: family, cluster_key, id, platform, handle, url, quoted, claim_type, summary, eta_text, eta_date (strings), rank (credibility, whole
number), confidence, reach (whole number), credible, posted_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import text
from pulsegrid.operators import rumors
from pulsegrid.operators.canon import with_component

PRODUCT = rumors.PRODUCT
#: Sources that a product keeps.
KEEP = 12
#: What a claim of a type adds to a product's state, besides its sources.
LEAD = "rank int, strength int, at long, confidence double, id long, summary string, eta_text string, eta_date string"


def lead() -> Column:
    """How claims compare: by credibility, then the stronger type, the later, the surer; larger is better."""
    return F.struct(
        F.col("rank").cast("int").alias("rank"), (-rumors.precedence(F.col("claim_type"))).cast("int").alias("strength"), F.unix_micros("posted_at").alias("at"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("id").cast("long").alias("id"), "summary", "eta_text", "eta_date",
    )


def eta_key() -> Column:
    """A time in words in one spelling; null if nothing is left of it."""
    return F.nullif(text.squash(F.col("eta_text")), F.lit(""))


def accumulate(claims: DataFrame, keep: int = KEEP) -> DataFrame:
    """One row for each product: claim_type, claim_summary, eta_text, eta_date, eta_conflicting, mention_count, platforms, sources, has_credible_source, first_seen_at, last_seen_at.

    The time is that of the best claim of the leading type that gives one. Sources are the best of each independent origin, the most credible ``keep`` of them.
    """
    timed = F.col("eta_text").isNotNull() | F.col("eta_date").isNotNull()
    typed = claims.groupBy(*PRODUCT, "claim_type").agg(
        F.max(lead()).alias("best"), F.max(F.when(timed, lead())).alias("timed"), F.array_sort(F.collect_set("platform")).alias("platforms"), F.max("credible").alias("credible"),
        F.min("posted_at").alias("first"), F.max("posted_at").alias("last"), *(f(c).alias(f"{n}_{k}") for c, k in ((eta_key(), "key"), (F.col("eta_date"), "date")) for f, n in ((F.min, "low"), (F.max, "high"))),
    )
    rows = typed.groupBy(*PRODUCT).agg(
        F.max(F.struct("best", "claim_type", "timed")).alias("top"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("platforms")))).alias("platforms"), F.max("credible").alias("has_credible_source"),
        F.min("first").alias("first_seen_at"), F.max("last").alias("last_seen_at"), *(f(f"{n}_{k}").alias(f"{n}_{k}") for k in ("key", "date") for f, n in ((F.min, "low"), (F.max, "high"))),
    )
    differs = F.coalesce(F.col("low_key") != F.col("high_key"), F.lit(False)) | F.coalesce(F.col("low_date") != F.col("high_date"), F.lit(False))
    return rows.join(origins(claims, keep), PRODUCT).select(
        *PRODUCT, "top.claim_type", F.col("top.best.summary").alias("claim_summary"), "top.timed.eta_text", "top.timed.eta_date", differs.alias("eta_conflicting"),
        "mention_count", "platforms", "sources", "has_credible_source", "first_seen_at", "last_seen_at",
    )


def source() -> Column:
    """How the sources of an origin compare; larger is better."""
    return F.struct(F.col("rank").cast("int").alias("rank"), F.unix_micros("posted_at").alias("at"), F.coalesce("reach", F.lit(0)).cast("long").alias("reach"), F.coalesce("url", F.lit("")).alias("url"))


def origins(claims: DataFrame, keep: int) -> DataFrame:
    """(family, cluster_key, mention_count, sources): a product's origins, and the URLs of the best ``keep`` in order."""
    tied = with_component(claims, PRODUCT, rumors.source_tokens(), "origin").groupBy(*PRODUCT, "origin").agg(F.max(source()).alias("s"))
    # the counts are partial in each task; of the ranked rows only the first few of a product leave a task
    counts = tied.groupBy(*PRODUCT).agg(F.count(F.lit(1)).alias("mention_count"))
    top = tied.withColumn("_r", F.row_number().over(Window.partitionBy(*PRODUCT).orderBy(F.desc("s"), "origin"))).where(F.col("_r") <= keep)
    listed = top.groupBy(*PRODUCT).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "s"))), lambda x: x["s"]["url"]).alias("sources"))
    return counts.join(listed, PRODUCT)


def all_claims(said: Column, recovered: Column) -> Column:
    """A post's claims from a model and those recovered from its text, in this order; null lists are empty."""
    empty = lambda c: F.coalesce(c, F.filter(F.coalesce(said, recovered), lambda x: F.lit(False)))
    return F.concat(empty(said), empty(recovered))


def listed_sources(products: DataFrame, key: list[str], sources: str, keep: int = KEEP) -> DataFrame:
    """For each product how many URLs its list of sources (structs with url, rank, score) shows, and the best ``keep`` in order; a product without a list stays, with none.

    Of a URL that is listed more than once the better entry counts.
    """
    each = products.select(*key, F.explode_outer(sources).alias("s")).groupBy(*key, F.nullif(F.col("s.url"), F.lit("")).alias("url")).agg(F.max(F.struct(F.coalesce("s.rank", F.lit(0)).alias("rank"), F.coalesce("s.score", F.lit(0)).alias("score"))).alias("best"))
    shown = F.when(F.col("url").isNotNull(), F.struct((-F.col("best.rank")).alias("rank"), (-F.col("best.score")).alias("score"), "url"))
    # the list of a product is as long as its sources were, since these come from a list
    return each.groupBy(*key).agg(F.count("url").alias("n_urls"), F.transform(F.slice(F.array_sort(F.array_compact(F.collect_list(shown))), 1, keep), lambda x: x["url"]).alias("top"))
