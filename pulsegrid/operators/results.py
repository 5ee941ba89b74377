"""What goes to a classifier and what comes back: texts of mentions, and validated results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import taxonomy


def clipped(said: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(said, F.lit("")), r"\s+", " ")), 1, most)


def mention_text(title: Column, body: Column, url: Column) -> Column:
    """Title and text on one line, the one up to 500 and the other up to 3,500 characters, after the community that they were posted in."""
    base = F.trim(F.regexp_replace(F.concat_ws(" ", clipped(title, 500), clipped(body, 3500)), r"\s+", " "))
    community = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)reddit\.com/r/([^/?#]+)", 1)
    return F.when((base == "") | (community == ""), base).otherwise(F.concat(F.lit("(posted in r/"), community, F.lit(") "), base))


def sanitised(said: Column) -> Column:
    """Without control characters other than line ends and tabs, which break a batch's JSON; halves of surrogate pairs can't occur in UTF-8."""
    return F.regexp_replace(F.coalesce(said, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def validated(rows: DataFrame, said: str = "said") -> DataFrame:
    """Add what a JSON answer holds, in the taxonomy's terms, with status and error; an answer of the wrong form can be retried."""
    field = lambda name: F.get_json_object(said, f"$.{name}")
    relevant, sure = field("relevant"), field("confidence").try_cast("double")
    sentiment = taxonomy.sentiment(field("sentiment"))
    error = (
        F.when(F.try_parse_json(said).isNull() | ~F.coalesce(F.col(said), F.lit("")).rlike(r"^\s*\{"), "result_not_object").when(relevant.isNull() | ~relevant.isin("true", "false"), "missing_relevant_boolean")
        .when((relevant == "true") & sentiment.isNull(), "missing_or_invalid_sentiment").when((relevant == "true") & sure.isNull(), "missing_confidence")
    )
    fine = error.isNull() & (relevant == "true")
    return rows.select(
        "*", F.when(error.isNull(), relevant == "true").alias("relevant"), F.when(fine, sentiment).alias("sentiment"),
        F.when(fine & (sentiment == "negative"), F.coalesce(taxonomy.complaint(field("complaint_category")), F.lit("other"))).alias("complaint_category"),
        F.when(fine & (sentiment == "positive"), taxonomy.praise(field("praise_category"))).alias("praise_category"),
        F.when(fine, F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).when(error.isNull(), 0.0).alias("confidence"),
        F.when(error.isNotNull(), "parse_error").when(fine, "classified").otherwise("irrelevant").alias("status"), error.alias("error"),
    )


def zipped(posts: DataFrame, answers: DataFrame, batch: str, place: str) -> DataFrame:
    """Answers (batch, results) laid beside the posts of their batch by place; posts beyond the last result say so and can be retried."""
    each = answers.select(F.col(batch).alias("_b"), F.posexplode("results").alias("_i", "said"))
    met = posts.join(each, (F.col(batch) == F.col("_b")) & (F.col(place) == F.col("_i")), "left")
    return met.withColumn("result_error", F.when(F.col("_i").isNull(), "missing_result_index")).drop("_b", "_i")
