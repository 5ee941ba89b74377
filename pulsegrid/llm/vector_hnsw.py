"""Approximate nearest neighbours: one hierarchical navigable small-world graph for each shard.

Vectors of one direction become one node that keeps the k + 1 smallest ids with their vectors, which is all that k nearest with
ties to the smaller id can need; so a vector that a third of all rows hold, in whatever lengths, is one node. (Directions whose
unit vectors agree to ``DIGITS`` decimals in every component count as one.) Nodes are dealt by a hash into shards of bounded bytes.

A shard's graph is built by insertion through the layers: a node descends from the top layer to its own, searches each layer from
there down with a beam, and links to diverse ones of those found (a candidate is taken if it's nearer to the node than to those
taken before); these link back, and a full list is thinned by the same rule. Nodes are inserted in random order, a batch at a time
that is no larger than what the graph holds already and whose nodes also see each other. The graph is stored as flat arrays:
vectors, levels and, for each layer, a rectangle of neighbour places.

The stated query rows meet every shard in blocks: a task loads a shard's graph once and streams the blocks through it; each search
walks greedily from the top layer down, then with a beam at the bottom, and returns its k best by exact double-precision cosine. A
final merge keeps the k best of all shards.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; a row that
repeats with its id and vector is one candidate; an id that has several vectors is asked by the smallest; a query is not its own
candidate (rows with its id are left out); vectors of another length than a query's are not compared with it; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded_batches, cut

#: Bytes of vectors that a shard is sized for, query vectors in a block, blocks that go to one copy of a shard, tasks to search with at least.
SHARD_BYTES = 1 << 23
QUERY_BLOCK = 256
BLOCKS = 64
TASKS = 12
#: Links of a node in a layer (twice as many at the bottom), nodes that an insertion looks at, nodes of a batch, decimals of a direction.
LINKS = 20
WIDE = 64
BATCH = 256
DIGITS = 10


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & fine & some).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square overflows; this changes no digit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def directions(vectors: np.ndarray) -> np.ndarray:
    x = scaled(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """(key, held): each direction with the k + 1 smallest (id, vector) pairs of its rows. Copies are thinned in each task before the shuffle."""
    bounded_batches(rows.sparkSession)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low: dict[bytes, set[tuple[int, bytes]]] = {}
            lists, ids = batch.column(1), batch.column(0).to_pylist()
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = flat[(ends[at] - d)[:, None] + np.arange(d)] + 0.0
                keys = np.round(directions(x), DIGITS) + 0.0
                for i, key, v in zip(at, keys, x, strict=True):
                    low.setdefault(key.tobytes(), set()).add((ids[i], v.tobytes()))
            held = [[{"id": i, "v": v} for i, v in sorted(x)[: k + 1]] for x in low.values()]
            yield pa.RecordBatch.from_pydict({"key": pa.array(low.keys(), pa.binary()), "held": pa.array(held, pa.list_(pa.struct([("id", pa.int64()), ("v", pa.binary())])))})

    thinned = rows.select("id", "v").mapInArrow(thin, "key binary, held array<struct<id:bigint,v:binary>>")
    once = thinned.groupBy("key", F.pmod(F.xxhash64("held"), F.lit(64)).alias("salt")).agg(lowest("held", k).alias("held"))
    return once.groupBy("key").agg(lowest("held", k).alias("held"))


def lowest(held: str, k: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(held)))), 1, k + 1)


def diverse(x: np.ndarray, centre: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the places found (rows of them, -1 where there is none) for each centre: near ones, nearer to it than to each other.

    If those are fewer, the nearest of the others fill the row.
    """
    s = np.where(found >= 0, np.einsum("nd,nkd->nk", centre, x[found]), -np.inf)
    by = np.argsort(-s, axis=1, kind="stable")[:, : 3 * most]
    found, s = np.take_along_axis(found, by, 1), np.take_along_axis(s, by, 1)
    v = x[found]
    among = v @ v.transpose(0, 2, 1)
    taken = np.zeros(found.shape, bool)
    for j in range(found.shape[1]):
        taken[:, j] = (found[:, j] >= 0) & ~((among[:, j, :] > s[:, j, None]) & taken).any(1) & (taken.sum(1) < most)
    rank = np.where(taken, 0, np.where(found >= 0, 1, 2)) * found.shape[1] + np.arange(found.shape[1])
    out = np.take_along_axis(found, np.argsort(rank, axis=1)[:, :most], 1)
    return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)


class Graph:
    """A shard's graph in flat arrays; ``tables[level]`` has a row for each node that is in the layer, found by ``row[level]``."""

    def __init__(self, unit: np.ndarray, levels: np.ndarray, tables: list[np.ndarray], entry: int):
        self.unit, self.levels, self.tables, self.entry = unit, levels, tables, entry
        self.row = [np.cumsum(levels >= level) - 1 for level in range(len(tables))]

    @classmethod
    def build(cls, unit: np.ndarray, seed: int, links: int = LINKS) -> Graph:
        """unit: float32 rows of length one. A node's level falls geometrically; the bottom has twice the links."""
        n, rng = len(unit), np.random.default_rng(seed)
        levels = np.minimum(-np.log(1 - rng.random(n)) / np.log(links), 12).astype(np.int64)
        order = rng.permutation(n)
        tables = [np.full((int((levels >= level).sum()), links * (1 + (level == 0))), -1, np.int32) for level in range(int(levels.max(initial=0)) + 1)]
        self = cls(unit, levels, tables, int(order[0]) if n else 0)
        at = min(1, n)
        while at < n:
            batch = order[at : at + min(BATCH, at)]
            self._insert(batch)
            at += len(batch)
        return self

    def _insert(self, batch: np.ndarray) -> None:
        x, q = self.unit, self.unit[batch]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        top = int(self.levels[self.entry])
        at = np.full(len(batch), self.entry)
        links: list[tuple[int, np.ndarray, np.ndarray]] = []
        for level in range(int(max(top, self.levels[batch].max())), -1, -1):
            mine = np.flatnonzero(self.levels[batch] >= level)
            found = np.full((len(mine), 0), -1, np.int64)
            if level <= top:
                passing = np.flatnonzero(self.levels[batch] < level)
                at[passing] = self._walk(q[passing], at[passing], level)
                found = self._beam(q[mine], at[mine], WIDE, level)
                if len(mine):
                    at[mine] = found[:, 0]
            if len(mine) > 1:  # the batch's own nodes of the layer
                near = np.argsort(-among[np.ix_(mine, mine)], axis=1)[:, : min(len(mine) - 1, LINKS)]
                found = np.concatenate([found, batch[mine][near]], 1)
            if len(mine) and found.shape[1]:
                links.append((level, batch[mine], diverse(x, q[mine], found, LINKS)))
        for level, nodes, chosen in links:
            self._link(level, nodes, chosen)
        highest = batch[np.argmax(self.levels[batch])]
        if self.levels[highest] > top:
            self.entry = int(highest)

    def _link(self, level: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """The nodes' links, and links back from those they chose."""
        table, row = self.tables[level], self.row[level]
        most = table.shape[1]
        table[row[nodes], : chosen.shape[1]] = chosen
        a, b = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        known = (table[row[b]] == a[:, None]).any(1)
        a, b = a[~known], b[~known]
        by = np.lexsort((a, b))
        a, b = a[by], b[by]
        ends, first, many = np.unique(b, return_index=True, return_counts=True)
        if not len(ends):
            return
        more = np.full((len(ends), many.max()), -1, np.int64)
        more[np.repeat(np.arange(len(ends)), many), np.arange(len(b)) - np.repeat(first, many)] = a
        held = table[row[ends]].astype(np.int64)
        free = (held < 0).sum(1)
        fits = free >= many
        both = np.concatenate([held, more], 1)
        # where there is room all stay, sorted so that empty places come last
        some = both[fits]
        table[row[ends[fits]]] = np.take_along_axis(some, np.argsort(some < 0, axis=1, kind="stable"), 1)[:, :most]
        full = np.flatnonzero(~fits)
        for i in range(0, len(full), 1024):
            part = full[i : i + 1024]
            table[row[ends[part]]] = diverse(self.unit, self.unit[ends[part]], both[part], most)

    def _walk(self, queries: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        """Greedily to the nearest node of a layer."""
        at = at.copy()
        best = np.einsum("md,md->m", queries, self.unit[at])
        moving = np.arange(len(at))
        while len(moving):
            near = self.tables[level][self.row[level][at[moving]]].astype(np.int64)
            node = np.where(near >= 0, near, at[moving, None])
            s = np.einsum("md,mkd->mk", queries[moving], self.unit[node])
            j = s.argmax(1)
            top = s[np.arange(len(moving)), j]
            up = top > best[moving]
            node, j, top, moving = node[up], j[up], top[up], moving[up]
            at[moving], best[moving] = node[np.arange(len(moving)), j], top
        return at

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Places (m, beam) of the nearest found, -1 where there are fewer; all queries walk together."""
        at = np.full(len(queries), self.entry)
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = self._walk(queries, at, level)
        return self._beam(queries, at, beam, 0)

    def _beam(self, queries: np.ndarray, at: np.ndarray, beam: int, level: int) -> np.ndarray:
        m, table, row = len(queries), self.tables[level], self.row[level]
        seen = np.zeros((m, len(self.unit)), bool)
        seen[np.arange(m), at] = True
        node, s = np.full((m, beam), -1, np.int64), np.full((m, beam), -np.inf, np.float32)
        node[:, 0], s[:, 0] = at, np.einsum("md,md->m", queries, self.unit[at])
        done = np.zeros((m, beam), bool)
        active = np.arange(m)
        while len(active):
            # each query opens its nearest nodes that are not yet open, a few at a time
            waiting = np.where(done[active] | (node[active] < 0), -np.inf, s[active])
            pick = np.argpartition(-waiting, 3, axis=1)[:, :4] if beam > 4 else np.argsort(-waiting, axis=1)[:, :4]
            open_ = np.take_along_axis(waiting, pick, 1) > -np.inf
            done[active[:, None], pick] |= open_
            more = open_.any(1)
            active, pick, open_ = active[more], pick[more], open_[more]
            if not len(active):
                break
            source = np.where(open_, np.take_along_axis(node[active], pick, 1), 0)
            near = np.where(open_[:, :, None], table[row[source]], -1).reshape(len(active), -1).astype(np.int64)
            near.sort(axis=1)
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            r, col = np.nonzero(fresh)
            found = near[r, col]
            seen[active[r], found] = True
            score = np.full(near.shape, -np.inf, np.float32)
            score[r, col] = np.einsum("nd,nd->n", queries[active[r]], self.unit[found])
            all_s = np.concatenate([s[active], score], 1)
            all_n = np.concatenate([node[active], np.where(fresh, near, -1)], 1)
            all_d = np.concatenate([done[active], np.zeros(near.shape, bool)], 1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            s[active], node[active], done[active] = (np.take_along_axis(x, top, 1) for x in (all_s, all_n, all_d))
        by = np.argsort(-s, axis=1, kind="stable")
        return np.take_along_axis(node, by, 1)


def build_index(rows: DataFrame, k: int, shards: int | None = None) -> DataFrame:
    """(shard, dim, vectors, ids, sizes, levels, entry, links): every node in the flat arrays of its shard's graph, written to the shared folder."""
    nodes = cut(nodes_of(rows, k), "vectors")
    shards = shards or max(1, -(-(nodes.agg(F.sum(F.length("key"))).first()[0] or 0) // SHARD_BYTES))
    dealt = nodes.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.length("key").alias("dim"), "key", "held")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        held = [sorted((x["id"], x["v"]) for x in h) for h in pdf.held]
        vectors = np.frombuffer(b"".join(v for h in held for _, v in h), np.float64).reshape(-1, int(key[1]) // 8)
        sizes = np.array([len(h) for h in held], np.int32)
        graph = Graph.build(directions(vectors[np.cumsum(sizes) - sizes]).astype(np.float32), int(key[0]))
        return pd.DataFrame({
            "shard": [key[0]], "dim": [key[1]], "vectors": [vectors.tobytes()], "ids": [np.array([i for h in held for i, _ in h], np.int64).tobytes()],
            "sizes": [sizes.tobytes()], "levels": [graph.levels.astype(np.int8).tobytes()], "entry": [graph.entry],
            "links": [[t.tobytes() for t in graph.tables]],
        })

    schema = "shard int, dim int, vectors binary, ids binary, sizes binary, levels binary, entry int, links array<binary>"
    return cut(dealt.groupBy("shard", "dim").applyInPandas(build, schema), "hnsw")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def load(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's graph, and the vectors, ids and bounds of its nodes' rows."""
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"] // 8)
    levels = np.frombuffer(row["levels"], np.int8)
    tables = [np.frombuffer(data, np.int32).reshape(int((levels >= level).sum()), -1) for level, data in enumerate(row["links"])]
    ids, first = np.frombuffer(row["ids"], np.int64), np.append(0, np.cumsum(np.frombuffer(row["sizes"], np.int32)))
    return Graph(directions(vectors[first[:-1]]).astype(np.float32), levels, tables, row["entry"]), vectors, ids, first


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = 96) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query (id, v), nearest first."""
    # queries in blocks of even size, dealt by a hash of the id
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    copies = max(-(-blocks // BLOCKS), min(blocks, -(-TASKS // shards)))
    block = queries.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), (F.size("v") * 8).alias("dim"), "id", "v")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"block": pdf.block[:1], "dim": pdf.dim[:1], "qids": [pdf.id.to_numpy(np.int64).tobytes()], "qs": [np.stack(list(pdf.v)).astype(float).tobytes()]})

    packs = block.groupBy("block", "dim").applyInPandas(gather, "block int, dim int, qids binary, qs binary")
    data = [f.name for f in index.schema if f.name not in ("shard", "dim")]
    none = [F.lit(None).cast(index.schema[c].dataType).alias(c) for c in data]
    asked = packs.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), (F.col("block") % copies).alias("copy"), "dim", F.lit(1).alias("kind"), *none, "qids", "qs")
    held = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "dim", F.lit(0).alias("kind"), *data, F.lit(None).cast("binary").alias("qids"), F.lit(None).cast("binary").alias("qs"))
    # a shard's graph comes first in its task, then its blocks
    dealt = held.unionByName(asked).repartition(shards * copies, "shard", "copy").sortWithinPartitions("shard", "copy", "dim", "kind")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, graph = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                here = (row["shard"], row["copy"], row["dim"])
                if row["kind"] == 0:
                    at, graph = here, load(row)
                elif here == at:
                    qs = np.frombuffer(row["qs"], np.float64).reshape(-1, row["dim"] // 8)
                    yield best(*graph, np.frombuffer(row["qids"], np.int64), qs, k, beam)

    found = dealt.mapInArrow(look, "query_id long, vec_id long, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(graph: Graph, vectors: np.ndarray, ids: np.ndarray, first: np.ndarray, qids: np.ndarray, qs: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
    """A shard's k best rows for each query of a block."""
    node = graph.search(directions(qs).astype(np.float32), beam)
    q, col = np.nonzero(node >= 0)
    at = node[q, col]
    many = (first[at + 1] - first[at]).astype(np.int64)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    owner, q = np.repeat(np.arange(len(at)), many), np.repeat(q, many)
    member = np.repeat(first[at], many) + step
    # of a direction the k smallest ids, without the query's own
    other = ids[member] != qids[q]
    owner, q, member = owner[other], q[other], member[other]
    few = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
    q, member = q[few], member[few]
    s = np.concatenate([np.zeros(0), *(cosine(qs[q[i : i + 8192]], vectors[member[i : i + 8192]]) for i in range(0, len(q), 8192))])
    by = np.lexsort((ids[member], -s, q))
    q, s, vec = q[by], s[by], ids[member][by]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return pa.RecordBatch.from_pydict({"query_id": qids[q[top]], "vec_id": vec[top], "score": s[top]})


def nearest(df: DataFrame, every: int = 50, k: int = 5, beam: int = 96, vec_id: str = "vec_id", vector: str = "embedding", shards: int | None = None) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by ``every``."""
    rows = usable(df, vec_id, vector)
    index = build_index(rows, k, shards)
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    return search(index, queries, k, beam)
