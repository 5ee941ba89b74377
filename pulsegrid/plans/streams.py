"""Queries over streams; their results equal those of the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.plans.views import SOURCES, pick, read, with_posts
from pulsegrid.shared import tables_dir
from pulsegrid.streaming import posts as stream


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream of posts."""
    schema = read(spark, folder, "events").schema
    # a file source takes folders or patterns; one table may be either a file or a folder of files
    events = stream.landed(spark, f"{folder}/event[s].parquet", schema)
    i = F.col("event_id")
    return events.select(i.alias("id"), pick(SOURCES, F.col("user_id") % 5).alias("source"), F.col("ts").cast("timestamp").alias("posted_at"), F.concat(F.lit("u"), (i - i % 3).cast("string")).alias("source_url"))


def fresh(spark: SparkSession, name: str) -> str:
    return f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream_hourly_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stream.run_available(stream.hourly_counts(arriving(spark, folder)), fresh(spark, "stream-hours"), ["hour", "source"])


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """URLs that arrived, each once."""
    return stream.run_available(stream.first_of_each(arriving(spark, folder), ["source_url"], "60 days").select("source_url"), fresh(spark, "stream-urls"))


QUERIES = {"stream_hourly_counts": stream_hourly_counts, "stream_dedup": stream_dedup}
ORACLE = {
    "stream_hourly_counts": with_posts("SELECT date_trunc('hour', posted_at) AS hour, source, count(*) AS n FROM posts GROUP BY ALL"),
    "stream_dedup": with_posts("SELECT DISTINCT source_url FROM posts"),
}
