"""Connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.shared import cut, remove, write_table

#: Edges up to which one task labels all components at once (some 100 MB there, whatever the nodes are); beyond that, rounds of joins.
ONE_TASK = 1 << 20


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over the links (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        new = np.minimum(new, new[low])
        while (new != new[new]).any():
            new = new[new]
        if (new == low).all():
            return low
        low = new


def in_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges (a, b)."""
    kind = edges.schema["a"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        held = pa.Table.from_batches(held)
        both = pa.chunked_array([*held.column("a").chunks, *held.column("b").chunks]).combine_chunks()
        names = both.unique()
        names = names.take(pc.sort_indices(names))
        place = pc.index_in(both, names).to_numpy()
        low = smallest_reached(len(names), place[: held.num_rows], place[held.num_rows :])
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(low))], ["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(label, f"node {kind}, root {kind}")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Label the nodes of ``edges`` (a, b) with the smallest node of their component: (node, root).

    Alternates large-star and small-star steps. Each step finds every node's smallest neighbour by an aggregation that is
    partial in each task, and hands it to the edges by a join on the node; after the first round a component's edges all end at
    its few smallest nodes, and the edges are kept by their larger end, so that a join meets each key about once. A round's
    result is written to the shared directory and the last one's removed. Rounds end when the edges no longer change; their
    number grows with the logarithm of the longest chain. Up to ``ONE_TASK`` edges are labelled by a single task instead. The labels are a
    written table, so those who use them twice don't find them twice.
    """
    spark = edges.sparkSession
    flat = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    path, schema = write_table(flat, "edges"), flat.schema
    if spark.read.schema(schema).parquet(path).count() <= ONE_TASK:
        return cut(in_one_task(spark.read.schema(schema).parquet(path)), "roots")
    last = None
    for _ in range(max_rounds):
        flat = spark.read.schema(schema).parquet(path)
        # large star: each node hands its larger neighbours to its smallest neighbour
        both = flat.select("a", "b").union(flat.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # an edge (a, b) asks its smaller end b for the smallest neighbour; ends that are roots already keep their edges as they are
        moved = low.where("m < a").select(F.col("a").alias("b"), "m")
        large = flat.join(moved, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        large = large.where("a > b").distinct()
        # small star: each node hands its smaller neighbours, and itself, to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = write_table(small.distinct(), "edges")
        remove(spark, path)
        path, flat = new, spark.read.schema(schema).parquet(new)
        now = flat.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last == tuple(now):
            break
        last = tuple(now)
    else:
        raise RuntimeError("connected components did not settle")
    roots = flat.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
