"""SimHash near-duplicates: BK-trees in pigeonhole shards.

A text's fingerprint holds the majority bits of its shingles' XXH64 hashes. Two fingerprints that
differ in at most r bits agree wholly in one of r + 1 blocks, so every fingerprint goes to r + 1 shards,
one for each (block, value of the block), and each link is found in at least one of them. A shard with
more than ``SHARD`` fingerprints is dealt out again by blocks of its remaining bits, as often as needed:
exact at every step, with no cap on a bucket; after four dealings what still shares all those blocks stays one shard,
whatever its size, and its fingerprints differ in few of the bits that are left. In each shard a BK-tree (children keyed by their integer
Hamming distance to the parent) answers which fingerprints lie within the radius; a search follows only
edges from d - r to d + r. The trees of a batch of shards are built and searched together with numpy.

Trees stay with their shard and are not broadcast as a whole, since that would grow with the corpus.
Equal fingerprints are one node, so a third of all rows may be copies; a shard hands on only edges that
join its nodes to the smallest node of their group there, so dense groups of near copies make no pairs.
Components then form by connected components over these edges.

Defined results: null and empty texts have fingerprint zero and link like any other; texts with fewer
words than a shingle are one shingle; repeated rows share their component; a null id plays no part in the
smallest id of a component; no documents, no rows; a very long text is one value in one task, in some ten times its size; further columns, whatever
their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import connected_components, cut, map_texts, smallest_reached

BITS = 64
#: Fingerprints of a shard beyond which it is dealt out again, and pairs looked at in one step.
SHARD = 4096
PAIRS = 1 << 20


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        of = xxhash.xxh64_intdigest
        hashes = [of(line[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.array(hashes[i : i + (1 << 16)], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3, text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``fp`` (signed 64 bits) of every row; no shuffle."""
    return map_texts(docs, lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]], "fp long", keep, text)


def cells(bits: list[int], n: int) -> list[list[int]]:
    """Deal bit places into n blocks of nearly equal size."""
    size, more = divmod(len(bits), n)
    ends = list(accumulate(size + (i < more) for i in range(n)))
    return [bits[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def block_value(places: list[int]) -> F.Column:
    """The bits of ``fp`` at these places, which follow one another."""
    return F.shiftrightunsigned("fp", places[0]).bitwiseAND(F.lit((1 << len(places)) - 1))


def sharded(fps: DataFrame, radius: int) -> DataFrame:
    """(shard, fp): two fingerprints within the radius share a shard; shards hold ``SHARD`` at most while bits remain."""
    todo = [(fps.select(F.lit("").alias("shard"), "fp"), list(range(BITS)), 0)]
    done: list[DataFrame] = []
    while todo:
        rows, bits, depth = todo.pop()
        blocks = cells(bits, radius + 1)
        new = [F.struct(F.concat("shard", F.lit(f"{i}:"), F.hex(runs(b)), F.lit("/")).alias("shard"), F.lit(i).alias("block")) for i, b in enumerate(blocks)]
        dealt = rows.select(F.explode(F.array(*new)).alias("x"), "fp").select("x.shard", "x.block", "fp")
        if len(blocks[-1]) < 2 or depth == 3:
            done.append(dealt.select("shard", "fp"))
            continue
        large = cut(dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SHARD), "large-shards")
        if large.isEmpty():
            done.append(dealt.select("shard", "fp"))
            continue
        done.append(dealt.join(large, "shard", "left_anti").select("shard", "fp"))
        for i, b in enumerate(blocks):
            rest = [x for x in bits if x not in set(b)]
            again = dealt.where(F.col("block") == i).join(large.where(F.col("block") == i).select("shard"), "shard", "left_semi")
            todo.append((again.select("shard", "fp"), rest, depth + 1))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def runs(places: list[int]) -> F.Column:
    """The bits of ``fp`` at these places, as one number."""
    value, start = F.lit(0).cast("long"), 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i] != places[i - 1] + 1:
            part = places[start:i]
            value = F.shiftleft(value, len(part)).bitwiseOR(block_value(part))
            start = i
    return value


class Forest:
    """A BK-tree for each group of fingerprints, held in flat arrays.

    The tree is the one that insertion in order makes: a node's children are keyed by their distance to it,
    and a fingerprint descends from the root of its group until an edge is free.
    """

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        n = len(fp)
        self.fp = fp
        self.root = np.zeros(int(group.max()) + 1 if n else 0, np.int64)
        _, first = np.unique(group, return_index=True)
        self.root[group[first]] = first
        self.parent, self.edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        falling = np.setdiff1d(np.arange(n), first)
        at = self.root[group[falling]]
        while len(falling):
            d = np.bitwise_count(fp[falling] ^ fp[at]).astype(np.int64)
            slot, first, back = np.unique(at * (BITS + 1) + d, return_index=True, return_inverse=True)
            child = falling[first]
            self.parent[child], self.edge[child] = slot // (BITS + 1), slot % (BITS + 1)
            at = child[back]
            stay = falling != at
            falling, at = falling[stay], at[stay]
        slots = np.where(self.parent < 0, -1, self.parent * (BITS + 1) + self.edge)
        self.order = np.argsort(slots, kind="stable")
        self.slots = slots[self.order]

    def search(self, query: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query's place, node) within the radius; each query searches the tree of its group."""
        q, node = np.arange(len(query)), self.root[tree]
        waiting = [(q, node)]
        while waiting:
            q, node = waiting.pop()
            if len(q) > PAIRS:
                half = len(q) // 2
                waiting += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(query[q] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            base = node * (BITS + 1)
            low = np.searchsorted(self.slots, base + np.maximum(d - radius, 0))
            high = np.searchsorted(self.slots, base + np.minimum(d + radius, BITS), side="right")
            many = high - low
            more = many > 0
            if more.any():
                q, low, many = q[more], low[more], many[more]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                waiting.append((np.repeat(q, many), self.order[np.repeat(low, many) + step]))


def shard_edges(fp: np.ndarray, group: np.ndarray, radius: int, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the smallest of its linked group in its shard, given in the order of (group, fp).

    nearest: also an edge from each to the nearest of its shard.
    """
    forest = Forest(fp, group)
    low = np.arange(len(fp))
    best = np.full(len(fp), (BITS + 1) * len(fp), np.int64)  # distance and place of the nearest as one number
    for i in range(0, len(fp), SHARD):
        for q, node in forest.search(fp[i : i + SHARD], group[i : i + SHARD], radius):
            q = q + i
            other = q != node
            if nearest:
                q, node, other = q[other], node[other], np.ones(other.sum(), bool)
                np.minimum.at(best, q, np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64) * len(fp) + node)
            if other.any():
                low = smallest_reached(len(fp), low[q[other]], low[node[other]])[low]
    joined = np.flatnonzero(low != np.arange(len(fp)))
    a, b = joined, low[joined]
    if nearest:
        found = np.flatnonzero(best < (BITS + 1) * len(fp))
        a, b = np.append(a, found), np.append(b, best[found] % len(fp))
    a, b = fp[a].view(np.int64), fp[b].view(np.int64)
    return np.maximum(a, b), np.minimum(a, b)


def links(fps: DataFrame, radius: int = 3, nearest: bool = False) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that keep every component of the links within the radius.

    nearest: also those from each fingerprint to the nearest one of each of its shards.
    """
    rows = sharded(fps.select("fp").distinct(), radius)
    dealt = rows.repartition(F.col("shard")).sortWithinPartitions("shard", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def edges(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.concatenate([[False], shard[1:] != shard[:-1]]))
            some = np.bincount(group)[group] > 1
            _, group = np.unique(group[some], return_inverse=True)
            a, b = shard_edges(fp[some].view(np.uint64), group, radius, nearest)
            return pa.RecordBatch.from_pydict({"a": a, "b": b})

        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False).astype(object)
            held.append((shard, batch.column("fp").to_numpy()))
            count += len(shard)
            if count >= 4 * SHARD and held[0][0][0] != shard[-1]:
                shard, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cutoff = int(np.argmax(shard == shard[-1]))  # the last shard may go on in the next batch
                yield edges(shard[:cutoff], fp[:cutoff])
                held, count = [(shard[cutoff:], fp[cutoff:])], len(shard) - cutoff
        if count:
            yield edges(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(docs: DataFrame, doc_id: str = "doc_id", shingle: int = 3, radius: int = 3, text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (doc_id, fingerprint, component_id), the smallest doc_id reachable."""
    fps = cut(fingerprints(docs, [doc_id], shingle, text).withColumnRenamed(doc_id, "id"), "fingerprints")
    ids = fps.groupBy("fp").agg(F.min("id").alias("low"))
    roots = connected_components(links(fps, radius))
    named = ids.join(roots, ids.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id")
    result = fps.join(by_fp, "fp", "left")
    return result.select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
