"""Posts as a stream: files of a landing folder in micro-batches, with watermarks for late rows.

Each function takes a streaming (or batch) table with ``posted_at`` and returns one; ``run_available`` processes what has arrived and
ends, as a scheduled job does. State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.streaming.tables import read_newest, snapshot_into

#: How late a post may come and still be counted.
LATENESS = "7 days"


def landed(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """The Parquet files of a landing folder as a stream, in batches of bounded size."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def hourly_counts(posts: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Posts of each UTC hour and source."""
    counted = posts.withWatermark("posted_at", lateness).groupBy(F.window("posted_at", "1 hour").alias("w"), "source").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("hour"), "source", "n")


def first_of_each(posts: DataFrame, key: list[str], lateness: str = LATENESS) -> DataFrame:
    """One row of each natural key, as long as its repeats come within the lateness."""
    return posts.withWatermark("posted_at", lateness).dropDuplicatesWithinWatermark(key)


def run_available(rows: DataFrame, folder: str, key: list[str] | None = None) -> DataFrame:
    """Write all that has arrived to ``folder`` as Parquet with its checkpoint beside it; the table so far.

    Without a key rows are appended. With one, rows may change until the watermark has passed them: each micro-batch puts those that did in place of the former
    ones, in a table of its own beside the last.
    """
    writer = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if key:
        query = writer.outputMode("update").foreachBatch(snapshot_into(folder, key)).start()
    else:
        query = writer.outputMode("append").format("parquet").option("path", f"{folder}/table").start()
    query.awaitTermination()
    if not key:
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/table")
    return read_newest(rows.sparkSession, folder, rows.schema)
