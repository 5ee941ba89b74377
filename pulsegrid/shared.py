"""The folder that driver and executors share, and cutting lineages with tables written there."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session may leave that unset: it gets a temporary folder of this process. On a cluster executors wouldn't see
    that folder, so there it's an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or local_dir()).rstrip("/")


@functools.cache
def local_dir() -> str:
    """For local sessions without ``spark.checkpoint.dir``; removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="pulsegrid-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, or all tables of the application: ``remove(spark, tables_dir(spark))``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tables_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; a job that has written its results may remove it as a whole."""
    return f"{shared_dir(spark)}/pulsegrid-{spark.sparkContext.applicationId}"


def write_table(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet to a fresh folder of the shared directory and return its path."""
    path = f"{tables_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared directory and read it again."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def write_text(lines: DataFrame, name: str, rows: int | None = None) -> str:
    """Write one column of text to a fresh folder of the shared directory and return its path; rows: so many in a file at most."""
    path = f"{tables_dir(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = lines.write if rows is None else lines.write.option("maxRecordsPerFile", rows)
    writer.text(path)
    return path
