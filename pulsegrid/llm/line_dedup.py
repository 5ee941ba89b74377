"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

The state is a table of reference counts (shard, key, n): in how many documents a line key occurs. A
key is the 16-byte BLAKE2b digest of the stripped line with A-Z lower-cased. For each shard a cuckoo
filter holds the keys whose count reaches the threshold, so that most lines are let through by a look
at two buckets; every hit is confirmed by the shard's exact list of these keys, which travels with the
filter. Insertions and deletions of documents add to and subtract from the counts, and move into or out
of the filters the keys that cross the threshold, so deleting what was inserted gives the former state
back; a filter that has grown full is made anew from its keys, twice as large.

Work is dealt out by key, never by document alone: a line that a third of all documents hold becomes
one count for each batch of texts before the shuffle, and its look-ups are spread over ``SALTS`` tasks. Of a
text that many rows hold, the rows are spread too when they meet the places of its lines.

Defined results: a null or empty text is one empty line; empty lines are never dropped (a key needs
``min_chars`` code points); repeated rows count as documents of their own; ids may be null or repeat,
since rows meet their lines again by the text's digest; no documents, no rows; a very long text is one value in one task; columns that aren't
asked for, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded_batches, cut, text_bytes

SPACE = b" \t\n\x0b\x0c\r"
#: Keys that a filter is sized for, and over how many tasks a shard's look-ups are spread.
SHARD_KEYS = 100_000
SALTS = 64
#: A text counts as hot if more than this part of all rows hold it, so there are fewer hot texts than this number.
HOT = 1000
SLOTS = 4
KICKS = 500


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def code_points(line: bytes) -> int:
    return len(line) - sum(b & 0xC0 == 0x80 for b in line)


def digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def text_keys(text: bytes, min_chars: int) -> dict[bytes, list[int]]:
    """The distinct keys of a text and the places of their lines."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        key = line_key(line)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or code_points(key) >= min_chars):
            found.setdefault(key, []).append(i)
    return {digest(k): v for k, v in found.items()}


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may lie in either of two buckets, and can be deleted.

    Keys that find no place after ``KICKS`` moves, and keys beyond the second copy of a fingerprint pair, go to
    an exact overflow set, so an insertion never fails.
    """

    def __init__(self, capacity: int):
        self.buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)
        self.overflow: set[bytes] = set()

    @property
    def capacity(self) -> int:
        return int(self.buckets * SLOTS * 0.85)

    @staticmethod
    def _scatter(fp: np.ndarray) -> np.ndarray:
        return (fp.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(20)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys, given as an array (n, 2) of unsigned 64-bit words."""
        with np.errstate(over="ignore"):
            fp = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
            fp[fp == 0] = 1
            mask = np.uint64(self.buckets - 1)
            one = keys[:, 0] & mask
            return fp, one.astype(np.int64), ((one ^ self._scatter(fp)) & mask).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        fps, ones, twos = self.places(keys)
        other = lambda b, f: int((b ^ int(self._scatter(np.array([f], np.uint16))[0])) & (self.buckets - 1))
        rows = self.table.tolist()
        for k, (f, a, b) in enumerate(zip(fps.tolist(), ones.tolist(), twos.tolist(), strict=True)):
            for place in (a, b):
                if 0 in rows[place]:
                    rows[place][rows[place].index(0)] = f
                    break
            else:
                path, at = [], a
                for kick in range(KICKS):
                    slot = (k + kick) % SLOTS
                    path.append((at, slot, rows[at][slot]))
                    f, rows[at][slot] = rows[at][slot], f
                    at = other(at, f)
                    if 0 in rows[at]:
                        rows[at][rows[at].index(0)] = f
                        break
                else:
                    for place, slot, was in reversed(path):
                        rows[place][slot] = was
                    self.overflow.add(keys[k].tobytes())
        self.table = np.array(rows, np.uint16)

    def delete(self, keys: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for key, f, a, b in zip(keys, *self.places(keys), strict=True):
            if key.tobytes() in self.overflow:
                self.overflow.remove(key.tobytes())
                continue
            for place in (a, b):
                hit = np.flatnonzero(self.table[place] == f)
                if len(hit):
                    self.table[place, hit[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, one, two = self.places(keys)
        found = (self.table[one] == fp[:, None]).any(1) | (self.table[two] == fp[:, None]).any(1)
        if self.overflow:
            found |= np.fromiter((k.tobytes() in self.overflow for k in keys), bool, len(keys))
        return found

    def to_bytes(self) -> bytes:
        return np.array([self.buckets, len(self.overflow)], np.int64).tobytes() + self.table.tobytes() + b"".join(sorted(self.overflow))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets, more = np.frombuffer(data, np.int64, 2).tolist()
        self = cls(1)
        self.buckets, end = buckets, 16 + buckets * SLOTS * 2
        self.table = np.frombuffer(data[16:end], np.uint16).reshape(buckets, SLOTS).copy()
        self.overflow = {data[end + 16 * i : end + 16 * i + 16] for i in range(more)}
        return self


def text_digest(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def words(keys: list[bytes] | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def counts(docs: DataFrame, min_chars: int = 1, text: str = "text") -> DataFrame:
    """(key, n): in how many documents each key occurs. Each task sends a key once for every batch of texts."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, int] = {}
            for t in batch.column(0).to_pylist():
                for k in text_keys(t, min_chars):
                    found[k] = found.get(k, 0) + 1
            yield pa.RecordBatch.from_pydict({"key": pa.array(found.keys(), pa.binary()), "n": pa.array(found.values(), pa.int64())})

    return docs.select(text_bytes(text).alias("t")).mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


class LineIndex:
    """Reference counts and filters of the documents inserted so far."""

    def __init__(self, refs: DataFrame, filters: DataFrame, shards: int, min_docs: int, min_chars: int):
        self.refs, self.filters, self.shards, self.min_docs, self.min_chars = refs, filters, shards, min_docs, min_chars

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shards: int | None = None, text: str = "text") -> LineIndex:
        refs = cut(counts(docs, min_chars, text), "line-counts")
        frequent = refs.where(F.col("n") >= min_docs)
        shards = shards or 16 + frequent.count() // SHARD_KEYS
        rows = frequent.select(shard_of(shards).alias("shard"), "key")
        filters = rows.groupBy("shard").applyInPandas(
            lambda pdf: pd.DataFrame({"shard": pdf.shard[:1], **filled(None, b"", pdf.key, ())}), "shard int, filter binary, keys binary"
        )
        return cls(refs, cut(filters, "line-filters"), shards, min_docs, min_chars)

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._changed(counts(docs, self.min_chars, text))

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Take documents out that were inserted before."""
        return self._changed(counts(docs, self.min_chars, text).select("key", (-F.col("n")).alias("n")))

    def _changed(self, delta: DataFrame) -> LineIndex:
        least = self.min_docs
        both = self.refs.select("key", F.col("n").alias("old"), F.lit(0).cast("long").alias("more")).union(delta.select("key", F.lit(0).cast("long"), "n"))
        both = cut(both.groupBy("key").agg(F.sum("old").alias("old"), (F.sum("old") + F.sum("more")).alias("n")), "line-delta")
        crossed = both.where((F.col("old") >= least) != (F.col("n") >= least)).select(shard_of(self.shards).alias("shard"), "key", (F.col("n") >= least).alias("enters"))

        def change(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            shard = old.shard.iloc[0] if len(old) else new.shard.iloc[0]
            data, keys = (old["filter"].iloc[0], old["keys"].iloc[0]) if len(old) else (None, b"")
            return pd.DataFrame({"shard": [shard], **filled(data, keys, new.key[new.enters], new.key[~new.enters])})

        filters = self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(change, "shard int, filter binary, keys binary")
        refs = both.where("n > 0").select("key", "n")
        return LineIndex(cut(refs, "line-counts"), cut(filters, "line-filters"), self.shards, least, self.min_chars)

    def frequent_lines(self, docs: DataFrame, text: str = "text", keep_first: bool = False) -> DataFrame:
        """(text_id, places, copies): for each distinct text with frequent lines, where they are, from 0, and how many rows hold the text.

        keep_first: without the lines of the text that has the smallest digest of all that hold the key.
        """
        min_chars, shards = self.min_chars, self.shards
        bounded_batches(docs.sparkSession)

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: dict[str, list] = {"text_id": [], "copies": [], "key": [], "places": []}
                for t, n in Counter(batch.column(0).to_pylist()).items():
                    found = text_keys(t, min_chars)
                    out["text_id"] += [text_digest(t)] * len(found)
                    out["copies"] += [n] * len(found)
                    out["key"] += found.keys()
                    out["places"] += found.values()
                kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict({c: pa.array(x, k) for (c, x), k in zip(out.items(), kinds, strict=True)})

        salt = F.pmod(F.xxhash64("text_id"), F.lit(SALTS)).cast("int")
        line = {"text_id": "binary", "copies": "bigint", "key": "binary", "places": "array<int>"}
        schema = ", ".join(f"{c} {t}" for c, t in line.items())
        lines = docs.select(text_bytes(text).alias("t")).mapInArrow(split, schema)
        lines = lines.select(shard_of(shards).alias("shard"), salt.alias("salt"), F.lit(1).alias("kind"), *line, *(F.lit(None).cast("binary").alias(c) for c in ("filter", "keys")))
        none = [F.lit(None).cast(t).alias(c) for c, t in line.items()]
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), *none, "filter", "keys")
        # a shard's filter comes first in its task, then the lines, one batch at a time
        dealt = filters.union(lines).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = held = sure = None
            for batch in batches:
                shard = batch.column("shard").to_numpy()
                first = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    part = batch.slice(a, b - a)
                    if shard[a] != at:
                        at, held = shard[a], None
                    some = np.flatnonzero(part.column("kind").to_numpy() == 0)
                    if len(some):
                        held = CuckooFilter.from_bytes(part.column("filter")[int(some[-1])].as_py())
                        sure = np.frombuffer(part.column("keys")[int(some[-1])].as_py(), "S16")
                    part = part.filter(part.column("kind").to_numpy() == 1) if held else part.slice(0, 0)
                    if part.num_rows:
                        keys = part.column("key").to_pylist()
                        hit = np.flatnonzero(held.contains(words(keys)))
                        asked = np.array([keys[i] for i in hit], "S16")
                        place = np.minimum(np.searchsorted(sure, asked), len(sure) - 1)
                        yield part.select(list(line)).take(pa.array(hit[sure[place] == asked]))

        hits = dealt.mapInArrow(look, schema)
        if keep_first:
            hits = cut(hits, "line-hits").withColumn("salt", salt)
            owners = hits.groupBy("key").agg(F.min("text_id").alias("owner"))
            owners = owners.select("key", "owner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            hits = hits.join(owners, ["key", "salt"]).where("text_id != owner")
        # every batch gives one row for each key of a text, and no place belongs to two keys
        return hits.groupBy("text_id").agg(F.collect_set("places").alias("x"), F.sum("copies").alias("n")).select("text_id", F.flatten("x").alias("places"), (F.col("n") / F.size("x")).cast("long").alias("copies"))


def filled(data: bytes | None, keys: bytes, enter: pd.Series, leave: pd.Series) -> dict[str, list[bytes]]:
    """A shard's filter and sorted keys after keys left and entered; a new filter, or one made anew, has room for twice its keys."""
    left, came = set(leave), set(enter)
    held = sorted(({keys[i : i + 16] for i in range(0, len(keys), 16)} - left) | came)
    cuckoo = CuckooFilter.from_bytes(data) if data is not None else CuckooFilter(2 * len(held))
    if data is None or len(held) > cuckoo.capacity:
        cuckoo = CuckooFilter(2 * len(held))
        left, came = set(), set(held)
    if left:
        cuckoo.delete(words(sorted(left)))
    if came:
        cuckoo.insert(words(sorted(came)))
    return {"filter": [cuckoo.to_bytes()], "keys": [b"".join(held)]}


def drop_frequent_lines(docs: DataFrame, index: LineIndex, keep: list[str], text: str = "text", keep_first: bool = False) -> DataFrame:
    """The ``keep`` columns of every row with ``kept_text``, n_lines and n_dropped.

    Rows meet the places of their frequent lines by the text's digest; those of hot texts by a salt besides.
    """
    spark = docs.sparkSession
    places = cut(index.frequent_lines(docs, text, keep_first), "line-places")
    total = docs.count()
    hot = places.where(F.col("copies") * HOT > total).select(F.col("text_id").alias("hot_id"))  # fewer than HOT rows, whatever the table
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), text_bytes(text).alias("t"))
    kinds = [f"k{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(keep))]
    n = len(keep)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, total, dropped = [], [], []
            for t, gone in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                lines = t.split(b"\n")
                total.append(len(lines))
                dropped.append(len(gone or ()))
                if gone:
                    gone = set(gone)
                    lines = [x for i, x in enumerate(lines) if i not in gone]
                out.append(b"\n".join(lines))
            made = [pa.array(out, pa.binary()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], [*batch.schema.names[:n], "kept", "n_lines", "n_dropped"])

    bounded_batches(spark)
    tagged = rows.withColumn("text_id", F.unhex(F.sha2("t", 256))).join(F.broadcast(hot), F.col("text_id") == F.col("hot_id"), "left")
    tagged = tagged.withColumn("salt", F.when(F.col("hot_id").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0))
    spread = F.when(F.col("copies") * HOT > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = places.select("text_id", "places", F.explode(spread).alias("salt"))
    joined = tagged.join(salted, ["text_id", "salt"], "left").select(*(f"k{i}" for i in range(n)), "t", "places")
    result = joined.mapInArrow(rebuild, ", ".join([*kinds, "kept binary", "n_lines long", "n_dropped long"]))
    return result.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("kept").cast("string").alias("kept_text"), "n_lines", "n_dropped")
