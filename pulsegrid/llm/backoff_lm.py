"""Language-model scoring with a weighted backoff automaton.

Smoothed n-grams become states: reading token w in the state of a history h follows the arc (h, w) if that
n-gram was seen, with weight (c(h w) + mu * p(w | h')) / (c(h) + mu), else the failure arc to the state of the
shorter history h' with weight mu / (c(h) + mu), and so on down to the unigrams. These are the predictive
probabilities of a hierarchical Dirichlet prior with a mu for each order; in every state they sum to one.
Unigrams are discounted: (c - d) / N for a seen token; the mass d * V / N goes to the unseen token, one type
as in the base score.

The model is as large as the corpus asks for, so it's never collected or broadcast. Texts are encoded once
into blocks of bounded size, written to the shared folder. Each block sends the distinct n-grams it holds,
with their counts in training texts, to shards by the first bits of the n-gram's hash; a shard adds up what its
blocks sent and answers each block for exactly the n-grams it named. So a frequent word or pair is one number
for each block, shards stay of even size, and the part of the automaton that a block's texts can reach fits in
a task. There the states and arcs are laid out in flat arrays, and the texts are read from left to right, many at
once: each carries its state and adds up log10 weights. A long text is read in pieces; a piece is led in by the
last tokens before it, which alone settle its first state, so nothing differs from one walk.

Words are named by their XXH64, longer n-grams by a 64-bit mix of those hashes, all bits of which count; within a shard they
travel as differences of sorted numbers. A block asks a shard only for n-grams that it holds. The number of word types, which no
block could learn from its own words, is counted by the shards and enters at the end: it weighs on unseen tokens and on the base score's divisor, which are
sums over tokens. Blocks are written bucketed by their number, so that they meet their answers without being shuffled.

Defined results: null and empty texts are the end token alone; repeated rows count each time; a null id hashes
as empty text; without any training text every token is unseen and has probability one; an empty table gives an empty one; a very long text is a block
of its own, in some fifty times its size; columns that aren't asked for, whatever their names, play no part.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded_batches, cut, tables_dir, text_bytes
from pulsegrid.llm.quality_rules import mixed

#: Bytes of text in a block (a longer text is a block of its own), tokens that a shard is sized for.
BLOCK_BYTES = 6 << 20
SHARD_TOKENS = 1 << 21
#: Over how many blocks below zero the shards' numbers of types are spread.
SPREAD = 1024
#: Tokens of a text that are read in one piece.
PIECE = 256
END = np.uint64(0xE0D)


class Encoder:
    """A block's texts as places in its own list of distinct words; place 0 is the end token."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        of, known = self.known.setdefault, self.known
        words = text.lower().split()
        ids = np.fromiter((of(w, len(known)) for w in words), np.uint32, len(words))
        self.texts.append(np.append(ids, np.uint32(0)))
        self.size += len(text)

    def row(self) -> tuple[bytes, bytes, bytes]:
        words = b" ".join(self.known)
        lengths = np.array([len(t) for t in self.texts], np.uint32)
        return squeezed(np.concatenate(self.texts), 6), lengths.tobytes(), len(words).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(words, asbytes=True)


def word_hashes(words: bytes) -> np.ndarray:
    """Hashes of a block's distinct words, the end token first."""
    size = int.from_bytes(words[:8], "little")
    known = pa.decompress(memoryview(words)[8:], size, "zstd", asbytes=True).split(b" ") if size else [b""]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in known), np.uint64, len(known))
    hashes[0] = END
    return hashes


def longer(histories: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams made of histories and words, from their hashes."""
    with np.errstate(over="ignore"):
        return mixed(histories * np.uint64(0x9E3779B97F4A7C15) + words)


class Block:
    """The n-grams of a block: for each order, their distinct hashes and, for each token, which of them ends there."""

    def __init__(self, tokens: bytes, lengths: bytes, words: bytes, trained: list[bool], order: int):
        ids = unsqueezed(tokens, np.int32)
        self.lengths = np.frombuffer(lengths, np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        words = word_hashes(words)
        self.trained = np.asarray(trained, bool)[self.doc]
        begins = np.cumsum(self.lengths) - self.lengths
        # a token's place in its text
        self.into = np.arange(len(ids), dtype=np.int32) - np.repeat(begins, self.lengths).astype(np.int32)
        at = words[ids]
        self.keys, self.which = [words], [ids]
        # an order-n gram that reaches over a text's beginning starts with its begin token, hash 0
        for n in range(2, order + 1):
            history = np.zeros(len(ids), np.uint64)
            for back in range(n - 1, 0, -1):
                before = np.zeros(len(ids), np.uint64)
                before[back:] = at[:-back]
                before[self.into < back] = 0
                history = longer(history, before)
            keys, which = np.unique(longer(history, at), return_inverse=True)
            self.keys.append(keys)
            self.which.append(which.astype(np.int32))

    def counts(self, n: int) -> np.ndarray:
        """How often each n-gram of order n ends a place in the block's training texts."""
        return np.bincount(self.which[n - 1][self.trained], minlength=len(self.keys[n - 1])).astype(np.uint32)

    def by_shard(self, n: int, shard_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the order-n keys, sorted, and where each shard's part begins and the last ends."""
        keys = self.keys[n - 1]
        place = np.argsort(keys) if n == 1 else np.arange(len(keys))  # longer ones are sorted already
        firsts = np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits)
        return place, np.append(np.searchsorted(keys[place], firsts), len(keys))


def encode(docs: DataFrame, keep: list[str], trained: Column, text: str = "text") -> DataFrame:
    """Blocks (block, keep columns as lists, trained, size, tokens, lengths, words), written to the shared folder in buckets by block; size: training tokens."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), trained.alias("trained"), text_bytes(text).alias("t"))
    n = len(keep)
    kinds = [f"k{i} array<{rows.schema[i].dataType.simpleString()}>" for i in range(n)]
    names = ["block", *(f"k{i}" for i in range(n)), "trained", "size", "tokens", "lengths", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        encoder, held = Encoder(), []

        def row(encoder: Encoder, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.array([c.to_pylist()], pa.list_(c.type)) for c in table.columns]
            data = [pa.array([x], pa.binary()) for x in encoder.row()]
            size = sum(len(t) for t, own in zip(encoder.texts, lists[-1][0].as_py(), strict=True) if own)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made], pa.int64()), *lists, pa.array([size], pa.int64()), *data], names)

        for batch in batches:
            start = 0
            for i, t in enumerate(batch.column(n + 1).to_pylist()):
                if encoder.size and encoder.size + len(t) > BLOCK_BYTES:
                    yield row(encoder, [*held, batch.slice(start, i - start).select(range(n + 1))])
                    encoder, held, start, made = Encoder(), [], i, made + 1
                encoder.add(t)
            held.append(batch.slice(start).select(range(n + 1)))
        if encoder.texts:
            yield row(encoder, held)

    schema = ", ".join(["block long", *kinds, "trained array<boolean>", "size long", "tokens binary", "lengths binary", "words binary"])
    return write_buckets(rows.mapInArrow(run, schema), "lm_blocks", "block")


def write_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write ``df`` to the shared folder in as many buckets by ``key`` as the session shuffles to, so that grouping by it needs no shuffle, and read it again.

    The table stays in the session's catalog under a name of its own; its files lie with the application's other tables.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", f"{tables_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def train_and_ask(blocks: DataFrame, order: int, shard_bits: int) -> DataFrame:
    """(block, n, shard, counts, types): for each block, the training counts of its own n-grams in the order of ``by_shard``; and rows of no block, as ``counted`` adds them."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time in memory
                x = batch.slice(i, 1).select(["block", "trained", "tokens", "lengths", "words"]).to_pylist()[0]
                b = Block(x["tokens"], x["lengths"], x["words"], x["trained"], order)
                for n in range(1, order + 1):
                    place, bounds = b.by_shard(n, shard_bits)
                    keys, count = b.keys[n - 1][place], b.counts(n)[place]
                    some = np.flatnonzero(np.diff(bounds))
                    parts = [slice(bounds[s], bounds[s + 1]) for s in some]
                    yield pa.RecordBatch.from_pydict({
                        "block": np.full(len(some), x["block"]), "n": np.full(len(some), n, np.int32), "shard": some.astype(np.int32),
                        "keys": pa.array([packed(keys[p]) for p in parts], pa.binary()),
                        "counts": pa.array([small(count[p]) for p in parts], pa.binary()),
                    })

    return counted(blocks.mapInArrow(split, "block long, n int, shard int, keys binary, counts binary"))


def counted(asked: DataFrame) -> DataFrame:
    """(block, n, shard, counts, types) for rows (block, n, shard, keys, counts): the sums over all blocks of each block's own keys.

    For each shard of single words there is one row more, of a block below zero, with ``types``: how many of its words occur in training texts.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [unpacked(k) for k in pdf["keys"]]
        sizes = [len(k) for k in each]
        keys, inverse = np.unique(np.concatenate(each), return_inverse=True)
        counts = np.concatenate([large(c) for c in pdf.counts])
        total = np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.uint64)
        answers = np.split(total[inverse].astype(np.uint32), np.cumsum(sizes)[:-1])
        out = pd.DataFrame({"block": pdf.block, "n": pdf.n, "shard": pdf.shard, "counts": [small(a) for a in answers], "types": 0})
        if pdf.n.iloc[0] == 1:
            shard = int(pdf.shard.iloc[0])
            out.loc[len(out)] = [-1 - shard % SPREAD, 1, shard, small(answers[0][:0]), int((total > 0).sum())]
        return out

    return asked.groupBy("n", "shard").applyInPandas(add, "block long, n int, shard int, counts binary, types long")


def squeezed(numbers: np.ndarray, level: int = 1) -> bytes:
    """Numbers, their first bytes together, then their second ones, and so on: high bytes are mostly alike and take little room."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    data = np.ascontiguousarray(planes).tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def unsqueezed(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(memoryview(data)[8:], size, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the differences: the low bytes of these, which nothing shortens, as they are, and the high ones squeezed."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    plain = min(7, (int(steps.mean()).bit_length() - 1) // 8) if len(steps) else 0
    plain = max(plain, 0)
    planes = np.ascontiguousarray(steps).view(np.uint8).reshape(len(steps), 8).T
    low, high = np.ascontiguousarray(planes[:plain]).tobytes(), np.ascontiguousarray(planes[plain:]).tobytes()
    return keys[:1].tobytes() + bytes([plain]) + len(steps).to_bytes(4, "little") + low + pa.Codec("zstd", compression_level=1).compress(high, asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    plain, n = data[8], int.from_bytes(data[9:13], "little")
    at = 13 + plain * n
    planes = np.empty((8, n), np.uint8)
    planes[:plain] = np.frombuffer(data, np.uint8, plain * n, 13).reshape(plain, n)
    if n:
        planes[plain:] = np.frombuffer(pa.decompress(memoryview(data)[at:], (8 - plain) * n, "zstd"), np.uint8).reshape(8 - plain, n)
    steps = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(np.append(np.frombuffer(data, np.uint64, 1), steps), dtype=np.uint64)


def small(counts: np.ndarray) -> bytes:
    """Counts in one byte each, and those of 255 or more once again in four; most are one."""
    more = counts[counts >= 255].astype(np.uint32).tobytes()
    return len(more).to_bytes(8, "little") + more + squeezed(np.minimum(counts, 255).astype(np.uint8))


def large(data: bytes) -> np.ndarray:
    end = 8 + int.from_bytes(data[:8], "little")
    counts = unsqueezed(data[end:], np.uint8).astype(np.uint32)
    counts[counts == 255] = np.frombuffer(data[8:end], np.uint32)
    return counts


class Automaton:
    """The part of the automaton that a block's texts can reach, in flat arrays.

    State 0 has the empty history; then come the beginnings of a text (histories of begin tokens alone) and one state for each
    n-gram, shorter than the order, that the training texts hold. ``fail`` and ``fail_weight`` are the failure arcs. ``arcs``
    holds (state, word) as one sorted number beside ``weight`` and ``target``; the arcs of state 0 are arrays by word.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], docs: int, tokens: int, mus: tuple[float, ...], discount: float):
        order = len(counts)
        self.words = len(block.keys[0])
        c = counts[0].astype(float)
        share = np.where(c > 0, (c - discount) / max(tokens, 1), 1.0)  # an unseen token's weight is added at the end
        # states: number of each history among the begin states and the n-grams of each length
        self.begin = order - 1
        states = [np.full(len(x), -1, np.int64) for x in counts[: order - 1]]
        held, fail, mu = [np.full(order, float(docs))], [np.maximum(np.arange(-1, order - 1), 0)], [np.array([0.0, *mus])]
        free = order
        firsts = [first_places(which, len(x)) for which, x in zip(block.which, counts, strict=True)]
        for n in range(1, order):
            seen = np.flatnonzero(counts[n - 1])
            states[n - 1][seen] = np.arange(free, free + len(seen))
            free += len(seen)
            held.append(counts[n - 1][seen].astype(float))
            mu.append(np.full(len(seen), mus[n - 1]))
            fail.append(np.zeros(len(seen), np.int64) if n == 1 else np.maximum(states[n - 2][block.which[n - 2][firsts[n - 1][seen]]], 0))
        self.fail = np.concatenate(fail)
        held, mu = np.concatenate(held), np.concatenate(mu)
        with np.errstate(divide="ignore"):
            self.fail_weight = np.log10(np.where(held > 0, mu / np.maximum(held + mu, 1e-300), 1.0))
        # arcs, from the short to the long: the weight of each rests on that of the n-gram without its first token
        self.first_weight = np.log10(share)
        self.first_target = np.maximum(states[0], 0) if order > 1 else np.zeros(self.words, np.int64)
        lower, keys, weights, targets = share, [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for n in range(2, order + 1):
            seen = np.flatnonzero(counts[n - 1])
            at = firsts[n - 1][seen]
            source = np.where(block.into[at] == 0, n - 1, states[n - 2][block.which[n - 2][at - 1]])
            below = block.which[n - 2][at]
            p = (counts[n - 1][seen] + mus[n - 2] * lower[below]) / (held[source] + mus[n - 2])
            target = states[n - 1][seen] if n < order else states[n - 2][below]
            sound = (source >= 0) & (target >= 0)  # all are, unless two n-grams share a number
            keys.append(source[sound] * self.words + block.which[0][at[sound]])
            weights.append(np.log10(p[sound]))
            targets.append(target[sound])
            lower = np.zeros(len(counts[n - 1]))
            lower[seen] = p
        arcs = np.concatenate(keys)
        by = np.argsort(arcs)
        self.arcs, self.weight, self.target = arcs[by], np.concatenate(weights)[by], np.concatenate(targets)[by]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state of each walker and the log10 weight of its way there: failure arcs until an arc has the word."""
        state, total = state.copy(), np.zeros(len(state))
        after = np.zeros(len(state), np.int64)
        open_ = np.arange(len(state))
        while len(open_):
            root = state[open_] == 0
            done = open_[root]
            total[done] += self.first_weight[word[done]]
            after[done] = self.first_target[word[done]]
            open_ = open_[~root]
            if not len(open_) or not len(self.arcs):
                break
            key = state[open_] * self.words + word[open_]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            found = self.arcs[at] == key
            done, at = open_[found], at[found]
            total[done] += self.weight[at]
            after[done] = self.target[at]
            open_ = open_[~found]
            total[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail[state[open_]]
        return after, total

    def traverse(self, block: Block) -> np.ndarray:
        """log10 weight of each text, read from left to right; a piece after a text's first is led in by ``begin`` tokens that add nothing."""
        lead = self.begin
        per_text = -(-block.lengths // PIECE)
        doc = np.repeat(np.arange(len(per_text)), per_text)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        begins = np.cumsum(block.lengths) - block.lengths
        start = begins[doc] + piece * PIECE
        end = np.minimum(start + PIECE, begins[doc] + block.lengths[doc])
        at = np.where(piece > 0, start - lead, start)
        by = np.argsort(at - end, kind="stable")  # the longest walk first: those still on their way stay in front
        doc, start, end, at, piece = doc[by], start[by], end[by], at[by], piece[by]
        state, total = np.where(piece > 0, 0, self.begin), np.zeros(len(doc))
        while len(at):
            going = int(np.searchsorted(at - end, 0))  # negative while tokens remain
            if not going:
                break
            at, end, start, state = at[:going], end[:going], start[:going], state[:going]
            state, gain = self.step(state, block.which[0][at].astype(np.int64))
            total[:going] += np.where(at >= start, gain, 0.0)
            at = at + 1
        return np.bincount(doc, weights=total, minlength=len(block.lengths))


def first_places(which: np.ndarray, n: int) -> np.ndarray:
    """Where each of n n-grams ends for the first time."""
    first = np.full(n, len(which), np.int64)
    np.minimum.at(first, which, np.arange(len(which)))
    return first


def score(
    docs: DataFrame, keep: list[str], trained: Column, mus: tuple[float, ...] = (256.0, 8.0), discount: float = 0.75, shard_bits: int | None = None, text: str = "text"
) -> DataFrame:
    """The ``keep`` columns of every row with n_tokens, n_known, train_tokens, base_score (add-one-half unigrams)
    and score (log10 probability of the text under the automaton).

    mus: the prior's weight for each order from two up, so they also settle the order (three by default).
    """
    order = 1 + len(mus)
    blocks = encode(docs, keep, trained, text)
    size = blocks.agg(F.sum("size"), F.sum(F.size(F.filter("trained", lambda x: x)))).first()
    tokens, trained_docs = size[0] or 0, size[1] or 0
    shard_bits = max(3, (tokens // SHARD_TOKENS).bit_length()) if shard_bits is None else shard_bits
    answers = train_and_ask(blocks, order, shard_bits)

    n = len(keep)
    names = [f"k{i}" for i in range(n)]
    kinds = [f"k{i} {blocks.schema[i + 1].dataType.elementType.simpleString()}" for i in range(n)]
    schema = ", ".join(["block long", *kinds, "n_tokens long", "n_known long", "base double", "walked double", "types long"])
    arrow = [blocks.schema[i + 1].dataType.elementType for i in range(n)]

    def walk(key: tuple, mine: pa.Table, said: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_type

        made_names = ["block", *names, "n_tokens", "n_known", "base", "walked", "types"]
        if not mine.num_rows:  # what shards say of their types
            number = pa.array([sum(said.column("types").to_pylist())], pa.int64())
            none = [pa.nulls(1, to_arrow_type(kind)) for kind in arrow]
            return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), *none, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), number], made_names)
        x = {c: mine.column(c)[0].as_py() for c in ("trained", "tokens", "lengths", "words")}
        block = Block(x["tokens"], x["lengths"], x["words"], x["trained"], order)
        counts = [np.zeros(len(k), np.uint32) for k in block.keys]
        places = [block.by_shard(k, shard_bits) for k in range(1, order + 1)]
        for k, s, c in zip(*(said.column(c).to_pylist() for c in ("n", "shard", "counts")), strict=True):
            place, bounds = places[k - 1]
            place = place[bounds[s] : bounds[s + 1]]
            counts[k - 1][place] = large(c)
        known = counts[0][block.which[0]]
        base = np.log10(known + 0.5)
        walked = Automaton(block, counts, trained_docs, tokens, mus, discount).traverse(block)
        per = lambda v: np.bincount(block.doc, weights=v, minlength=len(block.lengths))
        lists = [pa.array(mine.column(f"k{i}")[0].as_py(), to_arrow_type(arrow[i])) for i in range(n)]
        made = [block.lengths, per(known > 0).astype(np.int64), per(base), walked]
        return pa.Table.from_arrays([pa.array(np.full(len(block.lengths), key[0].as_py())), *lists, *map(pa.array, made), pa.nulls(len(block.lengths), pa.int64())], made_names)

    result = cut(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk, schema), "lm-walked")
    types = result.agg(F.sum("types")).first()[0] or 0
    unseen = math.log10(discount * types / tokens) if tokens and types else 0.0
    base = F.col("base") - F.col("n_tokens") * math.log10(tokens + 0.5 * (types + 1))
    scored = F.col("walked") + (F.col("n_tokens") - F.col("n_known")) * unseen
    return result.where("types is null").select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), scored.alias("score"))
