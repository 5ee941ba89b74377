"""Samples by overlapping quotas that are filled in stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def staged(rows: DataFrame, group: str, stages: list[tuple[str, Column, int]], target: int, order: str) -> DataFrame:
    """Rows of each group picked stage by stage, with ``stage``, the name of the stage that took them.

    A stage takes, in the order of a column without ties, up to its quota of the rows that meet its condition and aren't taken yet, as long as the group
    has fewer than ``target``. Of rows that meet the same conditions no more than the first ``target`` can be taken, and only these go on (a
    limit that each task applies before the shuffle), so a group of any size is a small one to the windows that count what is taken.
    """
    flags = [F.coalesce(c, F.lit(False)).alias(f"_f{i}") for i, (_, c, _) in enumerate(stages)]
    few = rows.select("*", *flags).withColumn("_r", F.row_number().over(Window.partitionBy(group, *(f"_f{i}" for i in range(len(stages)))).orderBy(order))).where(F.col("_r") <= target).drop("_r")
    few = few.withColumn("_stage", F.lit(None).cast("int"))
    every = Window.partitionBy(group)
    for i, (_, _, quota) in enumerate(stages):
        open_ = F.col(f"_f{i}") & F.col("_stage").isNull()
        place = F.sum(open_.cast("int")).over(every.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        few = few.withColumn("_open", open_).withColumn("_place", place).withColumn("_taken", F.count("_stage").over(every))
        fits = F.col("_open") & (F.col("_place") <= F.least(F.lit(quota), F.lit(target) - F.col("_taken")))
        few = few.withColumn("_stage", F.when(fits, i).otherwise(F.col("_stage"))).drop("_open", "_place", "_taken")
    names = F.element_at(F.array(*(F.lit(n) for n, _, _ in stages)), F.col("_stage") + 1)
    return few.where("_stage IS NOT NULL").withColumn("stage", names).drop("_stage", *(f"_f{i}" for i in range(len(stages))))
