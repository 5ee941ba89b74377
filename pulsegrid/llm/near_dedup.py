"""Near duplicates by SimHash and BK-trees, made whole by lists of rare shingles: one document of each group stays.

Two texts are near duplicates if their sets of ``shingle``-word shingles have a Jaccard similarity of ``least`` or more; groups are
the components of these links. Most texts have no partner, and that shows cheaply: a partner shares ``least`` of a text's shingles,
so a text of whose shingles fewer occur in other texts is alone. Therefore

1. texts are encoded into blocks, and every block learns for its shingles in how many rows each occurs (``backoff_lm.counted``: the
   distinct shingles of a block meet their sums in shards of even size). Only texts with enough shared shingles go on, as nodes: one for
   each sequence of words, however many copies it has. Texts themselves are never shuffled for this;
2. each node has two SimHash fingerprints, of its word pairs and of its distinct words. BK-trees in pigeonhole shards name, for each
   fingerprint, the smallest of its shard's group and the nearest; these pairs are compared by their shingles. One node of each
   linked group goes on to a further round, as long as a fair part of the pairs proves right: so dense groups make few pairs;
3. what these rounds leave apart is compared in full. With all shingles in one order, rare ones first, two sets as similar as ``least``
   share one of their first ``prefix_length``; so all nodes, also those that left the rounds, meet in the lists of these shingles, and
   every two of a list that can be similar and aren't in one group yet are compared, first those a few places apart and then those
   further off, as groups grow. No link is lost, and no list or group has a cap.

Shingles are named by 64-bit mixes of their words' XXH64.

Defined results: of each group the row with the smallest id stays (null ids come last; of equal ids, the text with the smaller digest);
rows of the same words are one group, null and empty texts too; texts of fewer words than a shingle are one shingle; rows that repeat
with id and text leave one; columns of any name are carried by their place; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.backoff_lm import SHARD_TOKENS, counted, encode, large, longer, packed, small, unsqueezed, word_hashes
from pulsegrid.llm.common import connected_components, cut, remove, write_table
from pulsegrid.llm.simhash_bktree import links

#: Rows to leave out, up to which they are broadcast (some 100 bytes each); beyond that the rows meet them by a shuffle.
BROADCAST_ROWS = 300_000
#: Part of a round's pairs that must be linked for another round; how many times further apart the next pairs of the lists lie.
WORTH = 0.05
WIDER = 16
#: Shingles of a block that are hashed at a time.
PART = 1 << 16


class Shingles:
    """The shingles of a block's texts: distinct keys, and for each text the places of its own."""

    def __init__(self, row: dict, shingle: int, shard_bits: int):
        ids = unsqueezed(row["tokens"], np.int32)
        words = word_hashes(row["words"])
        self.at = np.append(words[ids[ids > 0]], np.zeros(shingle, np.uint64))  # without the end tokens; a shingle may begin at the last word
        self.lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64) - 1
        self.begins = np.cumsum(self.lengths) - self.lengths
        many = np.maximum(1, self.lengths - shingle + 1)
        first = np.cumsum(many) - many
        doc = np.repeat(np.arange(len(many), dtype=np.int32), many)
        hashes = np.zeros(len(doc), np.uint64)
        for a in range(0, len(doc), PART):  # only results are as long as the block
            d, h = doc[a : a + PART], hashes[a : a + PART]
            into = np.arange(a, a + len(d)) - first[d]
            for k in range(shingle):
                h[:] = longer(h, np.where(into + k < self.lengths[d], self.at[self.begins[d] + into + k], np.uint64(0)))
        self.keys, pairs = np.unique(hashes, return_inverse=True)  # where each shingle is among the keys,
        del hashes
        for a in range(0, len(doc), PART):  # and whose it is
            pairs[a : a + PART] += doc[a : a + PART].astype(np.int64) * len(self.keys)
        pairs.sort()
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        self.doc, self.place = (pairs // len(self.keys)).astype(np.int32), (pairs % len(self.keys)).astype(np.int32)
        del pairs
        self.bounds = np.searchsorted(self.doc, np.arange(len(many) + 1))
        self.cutoffs = np.append(np.searchsorted(self.keys, np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits)), len(self.keys))

    def words_of(self, i: int) -> np.ndarray:
        return self.at[self.begins[i] : self.begins[i] + self.lengths[i]]


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: each bit that is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def prints(words: np.ndarray) -> list[int]:
    """A text's fingerprints by its word pairs and by its distinct words."""
    return [majority(longer(words[:-1], words[1:])), majority(np.unique(words))]


def prefix_length(n: np.ndarray | int, least: float) -> np.ndarray:
    """How many shingles, first in one order for all texts, of a set of n meet those of every set as similar as ``least``."""
    return n - np.ceil(least * n - 1e-9).astype(np.int64) + 1


def sharing(docs: DataFrame, doc_id: str, text: str, shingle: int, least: float) -> DataFrame:
    """Rows (id, digest, node, size, grams, counts, fps) that share enough shingles with other rows; a node's data come once for each block.

    node: digest of the words; grams: the node's shingles; counts: in how many rows each occurs.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = encode(rows, ["id", "digest"], F.lit(True))
    tokens = blocks.agg(F.sum("size")).first()[0] or 0
    shard_bits = max(3, (tokens // SHARD_TOKENS).bit_length())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time in memory
                x = batch.slice(i, 1).to_pylist()[0]
                s = Shingles(x, shingle, shard_bits)
                held = np.bincount(s.place, minlength=len(s.keys)).astype(np.uint32)
                some = np.flatnonzero(np.diff(s.cutoffs))
                parts = [slice(s.cutoffs[k], s.cutoffs[k + 1]) for k in some]
                yield pa.RecordBatch.from_pydict({
                    "block": np.full(len(some), x["block"]), "n": np.zeros(len(some), np.int32), "shard": some.astype(np.int32),
                    "keys": pa.array([packed(s.keys[p]) for p in parts], pa.binary()), "counts": pa.array([small(held[p]) for p in parts], pa.binary()),
                })

    asked = blocks.select("block", "tokens", "lengths", "words").mapInArrow(ask, "block long, n int, shard int, keys binary, counts binary")

    def answer(mine: pa.Table, said: pa.Table) -> pa.Table:
        x = {c: mine.column(c)[0].as_py() for c in ("tokens", "lengths", "words")}
        s = Shingles(x, shingle, shard_bits)
        counts = np.zeros(len(s.keys), np.uint32)
        for shard, c in zip(said.column("shard").to_pylist(), said.column("counts").to_pylist(), strict=True):
            counts[s.cutoffs[shard] : s.cutoffs[shard + 1]] = large(c)
        size = np.diff(s.bounds)
        common = np.bincount(s.doc, weights=counts[s.place] > 1, minlength=len(size))
        stay = np.flatnonzero(common >= least * size - 1e-9)
        nodes = [hashlib.blake2b(s.words_of(i).tobytes(), digest_size=16).digest() for i in stay]
        shown: set[bytes] = set()
        grams, held, fps = [], [], []
        for i, node in zip(stay, nodes, strict=True):
            if node in shown:
                grams, held, fps = [*grams, None], [*held, None], [*fps, None]
                continue
            shown.add(node)
            place = s.place[s.bounds[i] : s.bounds[i + 1]]
            grams.append(s.keys[place].tobytes())
            held.append(counts[place].tobytes())
            fps.append(prints(s.words_of(i)))
        places = pa.array(stay)
        ids, digests = (pa.array(mine.column(c).combine_chunks().flatten()).take(places) for c in ("k0", "k1"))
        made = [pa.array(nodes, pa.binary()), pa.array(size[stay], pa.int32()), pa.array(grams, pa.binary()), pa.array(held, pa.binary()), pa.array(fps, pa.list_(pa.int64()))]
        return pa.Table.from_arrays([ids, digests, *made], ["id", "digest", "node", "size", "grams", "counts", "fps"])

    schema = f"id {kind}, digest binary, node binary, size int, grams binary, counts binary, fps array<bigint>"
    return blocks.groupBy("block").cogroup(counted(asked).groupBy("block")).applyInArrow(answer, schema)


def place_of(id_: str = "id", digest: str = "digest") -> Column:
    """The order in which rows of a group stay."""
    return F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.col(digest).alias("digest"))


def nodes_of(rows: DataFrame, least: float) -> DataFrame:
    """(node, id, size, fps, grams, prefix, places) of the nodes that share enough shingles with other nodes.

    prefix: the shared ones among a node's first shingles, rare ones first; places: where they stand.
    """
    each = rows.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.first(F.when(F.col("grams").isNotNull(), F.struct("size", "fps", "grams", "counts")), ignorenulls=True).alias("x"))
    flat = each.select("node", F.xxhash64("node").alias("id"), "copies", "x.size", "x.fps", "x.grams", "x.counts")

    def rare_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, prefix, places = [], [], []
            for i, (copies, size, grams, counts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("copies", "size", "grams", "counts")), strict=True)):
                keys, held = np.frombuffer(grams, np.int64), np.frombuffer(counts, np.uint32)
                common = held > copies
                if common.sum() < least * size - 1e-9:
                    continue
                first = np.lexsort((keys, held))[: prefix_length(size, least)]
                at = np.flatnonzero(common[first])
                keep.append(i)
                prefix.append(keys[first[at]])
                places.append(at)
            kept = batch.select(["node", "id", "size", "fps", "grams"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(prefix, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], [*kept.schema.names, "prefix", "places"])

    return flat.mapInArrow(rare_first, "node binary, id long, size int, fps array<bigint>, grams binary, prefix array<bigint>, places array<int>")


def candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs of nodes (node, fps) to compare: (a, b), a above b."""
    each = nodes.select("node", F.posexplode("fps").alias("kind", "fp"))
    first = cut(each.groupBy("kind", "fp").agg(F.min("node").alias("first")), "first-of-fingerprint")
    equal = each.join(first, ["kind", "fp"]).select(F.col("node").alias("a"), F.col("first").alias("b"))
    named = first.groupBy("fp").agg(F.min("first").alias("first"))
    near = links(named.select("fp"), radius, nearest=True)
    near = near.join(named.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    return equal.union(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()


def whole_lists(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first one, put together so that rows equal there are never apart."""
    held: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        count += len(batch)
        if count >= most and held[0][0][0] != held[-1][0][-1]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cutoff = int(np.searchsorted(columns[0], columns[0][-1]))
            yield [c[:cutoff] for c in columns]
            held, count = [[c[cutoff:] for c in columns]], len(columns[0]) - cutoff
    if count:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def shared(nodes: DataFrame, least: float) -> DataFrame:
    """Rows (h, at, id, many) of the prefixes' shingles that texts of fitting sizes share; at: size and place, many: texts that hold h."""
    each = nodes.select("id", "size", F.explode(F.arrays_zip("prefix", "places")).alias("x"))
    dealt = each.select(F.col("x.prefix").alias("h"), F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("x.places")).alias("at"), "id").repartition("h").sortWithinPartitions("h", "at", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, at, i in whole_lists(batches):
            size = at >> 32
            fits = (h[1:] == h[:-1]) & (size[:-1] >= least * size[1:] - 1e-9)
            keep = np.append(fits, False) | np.append(False, fits)
            h, at, i = h[keep], at[keep], i[keep]
            _, back, many = np.unique(h, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": h, "at": at, "id": i, "many": many[back]})

    return dealt.mapInArrow(run, "h long, at long, id long, many long")


def near_in_lists(lists: DataFrame, least: float, low: int, high: int) -> DataFrame:
    """Pairs (x, y) of ids, of different roots, that can be similar and lie ``low`` to ``high`` - 1 places apart in a list (h, at, id, many, root)."""
    dealt = lists.select("h", "at", "id", "many", "root").repartition("h").sortWithinPartitions("h", "at", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_lists(batches):
            for d in range(low, high):
                rows = [c[rows[3] > d] for c in rows]
                h, at, i, _, root = rows
                if not len(h):
                    break
                p = np.flatnonzero((h[d:] == h[:-d]) & (root[d:] != root[:-d]))
                a, b = at[p], at[p + d]
                (m, k), (n, j) = (a >> 32, a & 0xFFFFFFFF), (b >> 32, b & 0xFFFFFFFF)
                fits = (m >= least * n - 1e-9) & (np.minimum(m - k, n - j) >= least / (1 + least) * (m + n) - 1e-6)
                x, y = i[p[fits]], i[p[fits] + d]
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                yield pa.RecordBatch.from_pydict({"x": pairs[:, 0], "y": pairs[:, 1]})

    return dealt.mapInArrow(run, "x long, y long").distinct()


def similarity(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def proven_links(pairs: DataFrame, nodes: DataFrame, least: float, name: str) -> DataFrame:
    """The pairs (x, y) of columns ``name`` of nodes that are as similar as ``least``, as nodes (a, b).

    Shingles travel once for each pair, with the one end, and once for each other end, which few pairs of a group differ in.
    """
    of = lambda side, key, grams: nodes.select(F.col(name).alias(side), F.col("node").alias(key), F.col("grams").alias(grams))
    ends = of("y", "b", "t").join(pairs.select("y").distinct(), "y", "left_semi")
    held = pairs.join(of("x", "a", "s"), "x").join(ends, "y").select("a", "b", "s", "t")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pa.array([similarity(x, y) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(near)

    return held.mapInArrow(prove, "a binary, b binary")


def groups(nodes: DataFrame, least: float, radius: int) -> DataFrame:
    """(node, root) for the nodes (see ``nodes_of``) that are linked to others."""
    lists = cut(shared(nodes, least), "shared-shingles")
    active, proven = nodes.select("node", "fps"), []
    while True:
        pairs = cut(candidates(active, radius), "candidates")
        linked = cut(proven_links(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")), nodes, least, "node"), "links")
        proven.append(linked)
        if linked.count() < WORTH * pairs.count() or pairs.isEmpty():
            break
        gone = linked.select(F.greatest("a", "b").alias("node")).distinct()  # each has a smaller one that it's linked to
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        active = cut(active.join(ends, "node", "left_semi").join(gone, "node", "left_anti"), "active")

    roots = connected_components(reduce(DataFrame.union, proven))
    longest = lists.agg(F.max("many")).first()[0] or 0
    low, high = 1, WIDER
    while low < longest:
        known = roots.select(F.xxhash64("node").alias("id"), F.xxhash64("root").alias("r"))
        apart = lists.where(F.col("many") > low).join(known, "id", "left").withColumn("root", F.coalesce("r", "id"))
        pairs = cut(near_in_lists(apart, least, low, high), "pairs-in-lists")
        linked = cut(proven_links(pairs, nodes, least, "id"), "links")
        if not linked.isEmpty():
            proven.append(linked)
            roots = connected_components(reduce(DataFrame.union, proven))
        low, high = high, WIDER * high
    return roots


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 5) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group, that with the smallest id stays."""
    spark = docs.sparkSession
    sharing_path = write_table(sharing(docs, doc_id, text, shingle, least), "sharing")
    rows = spark.read.parquet(sharing_path)
    nodes_path = write_table(nodes_of(rows, least), "nodes")
    nodes = spark.read.parquet(nodes_path)
    roots = groups(nodes, least, radius)
    first = rows.groupBy("node").agg(F.min(place_of()).alias("row"))
    first = first.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row"))
    stays = first.select(F.col("row.id").alias("x"), F.col("row.digest").alias("y"))
    same = F.col("id").eqNullSafe(F.col("x")) & (F.col("digest") == F.col("y"))
    counted_rows = rows.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n"))
    found = counted_rows.join(stays, same, "left").select("id", "digest", "n", F.col("y").isNotNull().alias("stays"))
    goes = cut(found.where("NOT stays OR n > 1"), "leaves")
    size = goes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("stays").cast("int")), F.lit(0))).first()
    for path in (sharing_path, nodes_path):
        remove(spark, path)

    new = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*new)
    mine = F.unhex(F.sha2(F.coalesce(F.col(new[docs.columns.index(text)]), F.lit("")).cast("binary"), 256))
    key = F.col(new[docs.columns.index(doc_id)]).eqNullSafe(F.col("id")) & (mine == F.col("digest"))
    side = F.broadcast if size[0] <= BROADCAST_ROWS else lambda x: x
    kept = named.join(side(goes), key, "left_anti")
    if size[1]:  # rows that repeat and stay: one of each
        again = named.withColumn("digest_", mine).join(side(goes.where("stays")), key, "left_semi")
        kept = kept.union(again.dropDuplicates([new[docs.columns.index(doc_id)], "digest_"]).select(*new))
    return kept.toDF(*docs.columns)
