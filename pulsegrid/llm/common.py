"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.operators.graph import connected_components, smallest_reached
from pulsegrid.shared import cut, remove, shared_dir, tables_dir, write_table

__all__ = ["connected_components", "cut", "remove", "shared_dir", "smallest_reached", "tables_dir", "write_table"]

#: Bytes of one Arrow batch sent to a Python worker, so that a batch of very long texts stays small; the session's option for others.
BATCH_BYTES = "16m"
BATCH_OPTION = "spark.pulsegrid.batchBytes"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, not only by rows (a text may be very long)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get(BATCH_OPTION, BATCH_BYTES))


def text_bytes(column: str = "text") -> Column:
    """A text as its UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def held_out(column: str, remainder: int, folds: int = 5) -> Column:
    """Whether crc32(id as text) mod ``folds`` is ``remainder`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds == remainder


def chunks(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with at most ``most`` bytes each, or a single longer text."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[bytes]], list]],
    schema: str,
    keep: list[str],
    text: str | Column = "text",
    most: int = 1 << 22,
) -> DataFrame:
    """Add to the ``keep`` columns those that a function returns for lists of whole texts (null: empty).

    ``make`` runs once a task and returns the function: from up to ``most`` bytes of texts (or one longer
    text) to one array for each field of ``schema``. Only the named columns of ``df`` reach Python, so
    further columns of the input, whatever their names, play no part.
    """
    bounded_batches(df.sparkSession)
    column = F.coalesce(text, F.lit("")).cast("binary") if isinstance(text, Column) else text_bytes(text)
    picked = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), column.alias("t"))
    kept = [f"k{i} {picked.schema[i].dataType.simpleString()}" for i in range(len(keep))]
    fields = T.StructType.fromDDL(schema)
    n, names, arrow = len(keep), fields.names, to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            texts = batch.column(n).to_pylist()
            for start, end in chunks(texts, most):
                made = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(function(texts[start:end]), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, end - start) for c in batch.columns[:n]), *made], [*batch.schema.names[:n], *names])

    result = picked.mapInArrow(run, ", ".join([*kept, schema]))
    return result.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *names)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, fold: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, target) from at most ``bound`` labels, chosen by a hash of the id; of an id that repeats, the smallest text.

    Only labels whose crc32(id as text) mod 5 isn't ``fold`` count. The sample of ids is small by its bound, so it is broadcast; as
    each id gives one row at most, so is what is fitted on.
    """
    fine = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id, fold))
    sample = fine.groupBy(doc_id).agg(F.max(label).cast("int").alias("target")).orderBy(F.xxhash64(doc_id), doc_id).limit(bound)
    sample = sample.select(F.col(doc_id).alias("sample_id"), "target")
    met = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(sample), F.col("id") == F.col("sample_id"))
    return met.groupBy("sample_id", "target").agg(F.min("t").alias("t")).select(F.col("sample_id").alias("doc_id"), F.col("t").alias("text"), "target")


def fit_in_one_task(sample: DataFrame, fit: Callable[[pa.Table], bytes]) -> bytes:
    """A model's bytes, fitted in one task on a bounded sample; the rows' order is that of their fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield pa.RecordBatch.from_pydict({"model": [fit(pa.Table.from_batches(held))]})

    found = sample.repartition(1).sortWithinPartitions(*sample.columns).mapInArrow(run, "model binary").collect()
    return bytes(found[0][0]) if found else b""
