"""Tables that a stream's micro-batches change by key: each micro-batch writes the table anew beside the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.shared import remove


def snapshot_into(folder: str, key: list[str], *order: Column) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: rows replace those with their key; of a micro-batch's rows of one key the last by an order counts.

    What is read never is half a table. A repeated micro-batch starts from the same table before it and writes the same; the tables before that one are removed,
    so two are kept, however many micro-batches there were.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = newest(spark, folder, number)
        rest = [c for c in batch.columns if c not in key]
        rows = batch.groupBy(*key).agg(F.max(F.struct(*order, F.struct(*rest).alias("x")))["x"].alias("x"))
        rows = rows.select(*key, *(f"x.{c}" for c in rest))
        if before is not None:
            old = spark.read.schema(batch.schema).parquet(f"{folder}/table-{before}")
            rows = old.join(rows, key, "left_anti").unionByName(rows)
        rows.write.mode("overwrite").parquet(f"{folder}/table-{number}")
        for old_number in numbers(spark, folder):
            if old_number < (before or 0):
                remove(spark, f"{folder}/table-{old_number}")

    return write


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The micro-batches whose table lies in a folder, whole."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    done = [f for f in files.listStatus(place) if f.getPath().getName().startswith("table-") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(f.getPath().getName().removeprefix("table-")) for f in done)


def newest(spark: SparkSession, folder: str, before: int | None = None) -> int | None:
    """The latest table's micro-batch, or the latest before one."""
    found = [n for n in numbers(spark, folder) if before is None or n < before]
    return found[-1] if found else None


def read_newest(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The table as the last micro-batch left it."""
    last = newest(spark, folder)
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{folder}/table-{last}")
