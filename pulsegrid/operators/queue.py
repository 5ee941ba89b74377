"""The classification work queue as column functions over posts: what is due, how a result changes a post, repairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ATTEMPTS = 5
# The marks of passing failures, wherever they stand and in either case.
TRANSIENT = [
    "classifier_error", "quota_deferred", "RESOURCE_EXHAUSTED", "UNAVAILABLE", "fetch failed", "timeout", "ETIMEDOUT", "ECONNRESET", "429", "500", "502",
    "503", "504", "Expected", "JSON", "position", "unparseable_response", "result_count_mismatch", "missing_result_index",
]


def due(posts: DataFrame, now: Column, limit: int, tie: str = "id") -> DataFrame:
    """The work to do next: pending or retried posts whose time has come, those without a time first."""
    ready = posts.where(F.col("status").isin("pending", "retry") & (F.col("next_at").isNull() | (F.col("next_at") <= now)) & (F.length(F.trim("title")) > 0))
    return ready.orderBy(F.asc_nulls_first("next_at"), "posted_at", tie).limit(limit)


def backoff_seconds(attempts: Column, retry_after_ms: Column | None = None) -> Column:
    """Seconds until the next attempt: 15 minutes, doubled with each attempt, a day at most; a given wait goes before."""
    doubled = F.least(F.lit(86400.0), 900.0 * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0)).cast("double")))
    if retry_after_ms is not None:
        doubled = F.when(retry_after_ms > 0, retry_after_ms / 1000.0).otherwise(doubled)
    return doubled.cast("long")


def transition(rows: DataFrame, now: Column) -> DataFrame:
    """Apply results (result_status, relevant, result_sentiment, result_confidence, result_error, retry_after_ms) to posts.

    A failed result is retried until the attempts are used up; one deferred for quota is never final.
    """
    failed = F.col("result_status") != "ok"
    attempts = F.coalesce(F.col("attempts"), F.lit(0)) + 1
    final = failed & (attempts >= MAX_ATTEMPTS) & (F.col("result_status") != "quota_deferred")
    status = F.when(final, "failed").when(failed, "retry").when(~F.col("relevant"), "irrelevant").otherwise("classified")
    wait = backoff_seconds(attempts, F.col("retry_after_ms"))
    return rows.select(
        "id",
        status.alias("status"),
        attempts.cast("int").alias("attempts"),
        F.when(failed & ~final, now + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))).alias("next_at"),
        F.when(~failed, now).alias("classified_at"),
        F.when(failed, F.coalesce("result_error", "result_status")).alias("error"),
        F.when(~failed & F.col("relevant"), F.col("result_sentiment")).alias("sentiment"),
        F.when(failed, F.lit(None)).when(F.col("relevant"), F.col("result_confidence")).otherwise(0.0).alias("confidence"),
    )


def bucketed(count: Column) -> Column:
    """A count shown only as 0, 1, 50 or 500."""
    return F.when(count == 0, 0).when(count < 50, 1).when(count < 500, 50).otherwise(500).cast("int")


def health(posts: DataFrame) -> DataFrame:
    """One row: bucketed numbers of queued, retried and failed posts, and the oldest ones."""
    waiting = F.col("status").isin("pending", "retry")
    return posts.agg(
        bucketed(F.count_if(F.col("status") == "pending")).alias("queued"),
        bucketed(F.count_if(F.col("status") == "retry")).alias("retrying"),
        bucketed(F.count_if(F.col("status") == "failed")).alias("failed"),
        F.min(F.when(waiting, F.col("created_at"))).alias("oldest_queued_at"),
        F.min(F.when(waiting, F.col("next_at"))).alias("next_attempt_at"),
    )


def exact_health(posts: DataFrame, now: Column) -> DataFrame:
    """One row: the numbers of queued, retried and failed posts, of failed ones of the last day, and the oldest that waits."""
    is_failed = F.col("status") == "failed"
    return posts.agg(
        F.count_if(F.col("status") == "pending").alias("queued"), F.count_if(F.col("status") == "retry").alias("retrying"), F.count_if(is_failed).alias("failed"),
        F.count_if(is_failed & (F.col("posted_at") >= now - F.make_dt_interval(days=F.lit(1)))).alias("recent_failed"),
        F.min(F.when(F.col("status").isin("pending", "retry"), F.col("created_at"))).alias("oldest_queued_at"),
    )


def error_group(error: Column) -> Column:
    low = F.lower(error)
    any_of = lambda *words: F.lit(False) if not words else low.rlike("|".join(words))
    return F.when(any_of("quota"), "quota").when(any_of("timeout", "abort"), "timeout").when(any_of("parse", "json"), "parse").when(any_of("api", "fetch"), "api").when(any_of("transient"), "transient").otherwise("other")


def reset_failed(posts: DataFrame, marks: list[str] = TRANSIENT) -> DataFrame:
    """Failed posts whose error will pass, put back to the beginning of the queue."""
    passing = reduce(or_, (F.col("error").ilike(f"%{m}%") for m in marks))
    return posts.where((F.col("status") == "failed") & passing).select("id", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("next_at"), F.lit(None).cast("string").alias("error"))


def recent_targeted(posts: DataFrame, models: DataFrame, now: Column, days: int = 7, after: Column | None = None, before: Column | None = None, offset: int = 0, size: int = 100) -> DataFrame:
    """(id, text, model_slug): a page of recent posts to be classified anew with the model they are filed under; those without text or known model are left out of the page.

    The window is that from ``after`` (else so many days back, one to thirty) up to ``before``, which is excluded; the newest come first.
    """
    since = after if after is not None else now - F.make_dt_interval(days=F.lit(min(max(days, 1), 30)))
    rows = posts.where(F.col("posted_at") >= since)
    rows = rows.where(F.col("posted_at") < before) if before is not None else rows
    page = rows.orderBy(F.desc("posted_at"), "id").offset(offset).limit(size)
    said = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit(""))))
    known = page.select("id", said.alias("text"), "model_id").join(models.select("model_id", F.col("slug").alias("model_slug")), "model_id")
    return known.where("text <> ''").select("id", "text", "model_slug")


def many_models(posts: DataFrame) -> DataFrame:
    """URLs under two models or more whose classified rows all have one sentiment."""
    rows = posts.where("status = 'classified'").groupBy("source_url").agg(F.count_distinct("model_id").alias("n_models"), F.count_distinct("sentiment").alias("n_sentiments"), F.min("sentiment").alias("sentiment"))
    return rows.where("n_models >= 2 and n_sentiments = 1").select("source_url", "n_models", "sentiment")


def classify(posts: DataFrame, classifier: Callable[[pd.Series], pd.DataFrame], schema: str, text: str = "title") -> DataFrame:
    """Run a classifier over the posts' texts: it gets a batch of texts and returns one row for each.

    Batches stream through the worker; a classifier that returns fewer rows leaves nulls for the rest.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = classifier(batch[text].fillna("")).reindex(range(len(batch)))
            yield pd.concat([batch[["id"]].reset_index(drop=True), said.reset_index(drop=True)], axis=1)

    return posts.select("id", text).mapInPandas(run, f"id long, {schema}")


# Fixed words of the deterministic stand-in for a language model.
GOOD, BAD = ["purchase", "signup", "love", "great"], ["error", "broken", "lazy", "worse"]


def lexicon_classifier(texts: pd.Series) -> pd.DataFrame:
    low = texts.str.lower()
    good, bad = low.str.contains("|".join(GOOD)), low.str.contains("|".join(BAD))
    sentiment = pd.Series("neutral", texts.index).mask(good & ~bad, "positive").mask(bad & ~good, "negative")
    return pd.DataFrame({"sentiment": sentiment.to_numpy(), "relevant": (texts.str.len() > 0).to_numpy()})
