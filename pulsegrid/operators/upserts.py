"""Writes as joins: insert-ignore, merge, additive and conditional upserts, repairs and retention. Parquet has no MERGE, so each
returns the new contents, keyed and shuffled once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.shared import remove


def insert_ignore(stored: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Stored rows and those new ones whose key isn't stored; of new rows with one key, the first. Neither table passes through the driver."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
    return stored.unionByName(first.join(stored.select(*key).hint("merge"), key, "left_anti"))


def merge(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace stored ones with their key."""
    return stored.join(new.select(*key), key, "left_anti").unionByName(new)


def add_up(stored: DataFrame, new: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """A ledger: counters of equal keys add up."""
    return stored.unionByName(new).groupBy(*key).agg(*(F.sum(c).cast("long").alias(c) for c in sums))


def requeue(stored: DataFrame, queued: DataFrame) -> DataFrame:
    """Put queued (id, attempts, next_at, error) into posts unless they are classified: most attempts, earliest time, first error."""
    q = queued.select("id", F.col("attempts").alias("q_attempts"), F.col("next_at").alias("q_next"), F.col("error").alias("q_error"), F.lit(True).alias("is_queued"))
    rows = stored.join(q, "id", "left")
    hit = F.coalesce("is_queued", F.lit(False)) & (F.col("status") != "classified")
    return rows.select(
        "id",
        F.when(hit, "pending").otherwise(F.col("status")).alias("status"),
        F.when(hit, F.greatest("attempts", "q_attempts")).otherwise(F.col("attempts")).alias("attempts"),
        F.when(hit, F.least(F.coalesce("next_at", "q_next"), "q_next")).otherwise(F.col("next_at")).alias("next_at"),
        F.when(hit, F.coalesce("error", "q_error")).otherwise(F.col("error")).alias("error"),
    )


def stuck_runs(runs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Runs that still say running after ``minutes`` become failed, with a message."""
    stuck = (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return runs.select(
        "id", F.when(stuck, "failed").otherwise(F.col("status")).alias("status"), F.when(stuck, now).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(stuck, f"stuck for over {minutes} minutes").otherwise("").alias("message"),
    )


def retained(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days``."""
    return rows.where(F.col(at) >= now - F.make_dt_interval(days=F.lit(days)))


def replace_range(path: str, new: DataFrame, part: str, first: str, last: str) -> None:
    """Put ``new`` in place of all partitions from ``first`` to ``last`` (as text, both included); all others stay.

    A day of the range for which ``new`` has no rows is emptied too. The partitions that there are are listed from the table's folders, one for each day.
    Rows are written first, then days without rows are removed, so a reader meets old or new days, and no half of one; a run that broke off is simply repeated.
    """
    spark = new.sparkSession
    wanted = new.where(F.col(part).between(first, last))
    held = [r[0] for r in wanted.select(F.col(part).cast("string")).distinct().collect()]  # at most one for each day of the range
    wanted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
    for name in names:
        key, _, value = name.partition("=")
        if key == part and first <= value <= last and value not in held:
            remove(spark, f"{path}/{name}")


def export_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header; cells with commas, quotes or line ends are quoted, and quotes doubled."""
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def checked(stored: DataFrame, seen: DataFrame, now: Column, url: str = "source_url") -> DataFrame:
    """Mark every row of a URL as checked if any of its rows was looked at; a row that has a mark keeps it."""
    marks = seen.select(url).distinct().withColumn("_hit", F.lit(True))
    return stored.join(marks, url, "left").withColumn("checked_at", F.coalesce("checked_at", F.when(F.col("_hit"), now))).drop("_hit")


def named_values(rows: DataFrame, key: list[str], array: str, document: str, path: str) -> DataFrame:
    """The distinct values of an array column and of a field in each object of a JSON array column, as sorted text."""
    of = F.transform(F.from_json(document, "array<string>"), lambda x: F.get_json_object(x, path))
    return rows.select(*key, F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce(array, F.array().cast("array<string>")), F.coalesce(of, F.array().cast("array<string>")))))).alias("found"))
