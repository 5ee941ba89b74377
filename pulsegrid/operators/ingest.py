"""From landed posts to stored rows of (post, model): keep gate, attribution, known titles, initial state, insert-ignore.

Joins with posts and stored rows are hinted to merge: compressed, such tables look small enough to be sent through the driver, whose memory they then fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import text
from pulsegrid.operators import upserts
from pulsegrid.operators.attribution import attribute
from pulsegrid.shared import cut

KEY = ["source_url", "model_id"]


def kept(posts: DataFrame) -> DataFrame:
    """Posts long enough to say something, and no mere shares unless they speak of a rumour or a release."""
    said = F.concat_ws(" ", "title", F.coalesce("body", F.lit("")))
    shared = F.concat_ws(" ", "title", F.coalesce("body", "link", F.lit("")))
    share = text.is_news(shared) | text.is_promotion(shared) | text.is_novelty(shared)
    return posts.where(text.long_enough(said) & (~share | text.is_rumor(shared) | text.is_release(shared)))


def named(posts: DataFrame, keywords: DataFrame, most: int | None = None, communities: DataFrame | None = None) -> DataFrame:
    """(source_url, slug, posted_at) of comments (source_url, body, posted_at, maybe community) that pass the keep gate and themselves name a model, or stand in its community.

    most: the latest so many comments, counted after gate and attribution, as a run takes them.
    """
    shape = posts.select("source_url", F.lit(None).cast("string").alias("title"), "body", F.lit(None).cast("string").alias("link"), "posted_at", *(["community"] if communities is not None else []))
    fine = cut(kept(shape), "kept-comments")
    found = attribute(fine, keywords, "source_url", "body", "community" if communities is not None else None, communities).join(fine.select("source_url", "posted_at"), "source_url")
    if most is None:
        return found
    latest = found.select("source_url", "posted_at").distinct().orderBy(F.desc("posted_at"), "source_url").limit(most)
    return found.join(latest.select("source_url"), "source_url", "left_semi")


def title_key() -> Column:
    return F.concat("model_id", F.lit(":"), F.lower(F.substring("title", 1, 80)))


def of_models(posts: DataFrame, keywords: DataFrame, models: DataFrame) -> DataFrame:
    """One row for each post and model (model_id, slug) that it names."""
    said = posts.withColumn("_said", F.concat_ws(" ", "title", F.coalesce("body", F.lit("")), F.coalesce("link", F.lit(""))))
    named = attribute(said, keywords, "source_url", "_said").join(F.broadcast(models.select("slug", "model_id")), "slug").drop("slug")
    return posts.join(named.hint("merge"), "source_url")


def unseen(rows: DataFrame, stored: DataFrame, since: Column) -> DataFrame:
    """Rows of posts of whose models at least one hasn't had the title since a time, and whose URL isn't stored.

    A post stays whole: if one of its models hasn't seen the title, all its rows stay, as the collectors do it.
    """
    titles = stored.where((F.col("posted_at") >= since) & F.col("title").isNotNull()).select(title_key().alias("_key"), F.lit(True).alias("_known")).distinct()
    rows = rows.join(stored.select("source_url").distinct().hint("merge"), "source_url", "left_anti")
    rows = rows.withColumn("_key", title_key()).join(titles.hint("merge"), "_key", "left")
    new = F.max(F.col("_known").isNull()).over(Window.partitionBy("source_url"))
    return rows.withColumn("_new", new).where("_new").drop("_key", "_known", "_new")


def with_state(rows: DataFrame, now: Column) -> DataFrame:
    """Add the state of a row's classification where it has none: done if a sentiment came with it, else waiting from now on."""
    given = lambda c, kind: (F.col(c) if c in rows.columns else F.lit(None)).cast(kind)
    status, said = given("status", "string"), F.coalesce(given("sentiment", "string"), F.lit("")) != ""
    state = lambda c, kind, done, waiting: F.when(status.isNotNull(), given(c, kind)).when(said, done).otherwise(waiting).cast(kind).alias(c)
    none = F.lit(None)
    names = ("status", "attempts", "next_at", "classified_at", "classifier_version", "error")
    return rows.select(
        *(c for c in rows.columns if c not in names), F.when(status.isNotNull(), status).when(said, "classified").otherwise("pending").alias("status"), state("attempts", "int", F.lit(1), F.lit(0)),
        state("next_at", "timestamp", none, now), state("classified_at", "timestamp", now, none), state("classifier_version", "string", F.lit("legacy-inline-v1"), none), state("error", "string", none, none),
    )


def stored_after(stored: DataFrame, posts: DataFrame, keywords: DataFrame, models: DataFrame, now: Column, days: int = 2) -> DataFrame:
    """The stored rows and those that landed posts add: the whole way from a reader's posts to the table."""
    rows = unseen(of_models(cut(kept(posts), "kept-posts"), keywords, models), stored, now - F.make_dt_interval(days=F.lit(days)))
    return upserts.insert_ignore(stored, with_state(rows, now).select(*stored.columns), KEY, ["posted_at", "title"])
