"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, each stage written as Parquet.

Each stage takes the rows that its predecessor kept, with all their columns, and works on whole texts. An empty table gives an empty one at every stage, further
columns are carried by position, so their names clash with nothing, and a very long text is one value in one task. The rest, stage by stage:

- quality rules: null and empty texts have no words, too few, and go; repeated rows are judged alike;
- line dedup: a null or empty text is one empty line, which is never dropped; repeated rows count as documents of their own; of documents that tie for the one copy of a
  frequent line that of the smallest digest keeps it;
- near duplicates: of each group the row with the smallest id stays, null ids last, of equal ids the text with the smaller digest; rows alike in id and text leave one; null and empty
  texts are one group;
- mixing: null sources and languages are leaves of their own; texts without words cost nothing and are taken while their leaf's share isn't met; ties go by the seeded digest;
- packing: null and empty texts are the end id alone; repeated rows are packed each; ties of equal length go by id, piece and checksum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from pulsegrid.llm.common import BATCH_OPTION, bounded_batches, cut
from pulsegrid.llm.queries import MIX_WEIGHTS, mix_levels, tokenizer_path

#: The part of all tokens that mixing spends, from one epoch.
MIX_SHARE = 0.9
#: Bytes of the Arrow batches: a batch is held several times at once by a task and its worker, which keep that room through all stages.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of this session's steps as the stages need it."""
    spark.conf.set(BATCH_OPTION, BATCH_BYTES)
    bounded_batches(spark)


def by_position(docs: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """The rows with columns c0, c1, ...; these names; and the new name of each old one."""
    new = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*new), new, dict(zip(docs.columns, new, strict=True))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    small_batches(spark)
    rows, new, of = by_position(docs)
    judged = quality_rules.quality_rules(rows, new, text=of["text"])
    return judged.where("kept").select(*new).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold stay in one of them only; n_chars follows the text."""
    small_batches(spark)
    rows, new, of = by_position(docs)
    index = line_dedup.LineIndex.build(rows, min_docs=10, min_chars=1, text=of["text"])
    kept = line_dedup.drop_frequent_lines(rows, index, new, of["text"], keep_first=True)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col(of["text"]))
    changed = {of["text"]: text}
    if "n_chars" in of:
        changed[of["n_chars"]] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(rows.schema[of["n_chars"]].dataType)).otherwise(F.col(of["n_chars"]))
    return kept.select(*(changed.get(c, F.col(c)).alias(c) for c in new)).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    small_batches(spark)
    return near_dedup.one_of_each(docs, "doc_id", "text", shingle=5, least=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen for the target weights of domains, languages and sources."""
    small_batches(spark)
    rows, new, of = by_position(docs)
    levels = mix_levels(of["lang"], of["source"])
    return mixing.mix(rows, new, levels, MIX_WEIGHTS, MIX_SHARE, doc_id=of["doc_id"], text=of["text"]).select(*new).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row for each piece of a document."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path(), most=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", pack),
]
#: Near-dedup and packing have no SQL form; the tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
