"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every token bucket has a fixed sparse index vector (a few entries of plus or minus one, drawn from its number). A bucket's
word vector is the sum of the index vectors of the tokens around it, over all documents; each task adds up what its texts
hold in one array of fixed size, and the arrays are summed in two steps. A document is the mean and the spread of its
tokens' vectors. On a bounded sample of labelled documents a network with one hidden layer is fitted by Adam; a slice that
it doesn't see sets the temperature that calibrates its probabilities.

Defined results: null and empty texts have zero features and get the network's score for them; repeated rows score alike;
without labels of both kinds every score is the share of label 1 (0 without labels); no documents, no rows; a very long text is one value in one task,
in some twenty times its size; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pulsegrid.llm.common import bounded_batches, chunks, fit_in_one_task, labelled_sample, map_texts, text_bytes

#: Token buckets, entries of a vector and how many of an index vector are set, tokens on either side, rows to fit on at most.
BUCKETS = 1 << 14
DIM = 16
SET = 4
WINDOW = 2
SAMPLE = 20_000
HIDDEN = 32
#: Rows of the summed array that travel together.
PART = 256
TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+")


def index_vectors() -> np.ndarray:
    """A vector for each bucket, and zeros for no token."""
    rng = np.random.default_rng(11)
    out = np.zeros((BUCKETS + 1, DIM), np.int32)
    place = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :SET]
    out[np.arange(BUCKETS)[:, None], place] = rng.choice([-1, 1], (BUCKETS, SET))
    return out


class Buckets(dict):
    """Token to bucket; forgets what it holds when it has grown."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[token] = k = zlib.crc32(token) % BUCKETS
        return k


class Tokens:
    """Buckets of texts' tokens: runs of letters and digits, and runs of signs."""

    def __init__(self) -> None:
        self.bucket = Buckets().__getitem__

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = array("i"), []
        for t in texts:
            found = TOKEN.findall(t)
            lengths.append(len(found))
            ids.extend(map(self.bucket, found))
        return np.array(ids, np.int32), np.array(lengths, np.int64)


def neighbours(ids: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each distinct bucket, the sum of the index vectors around its tokens; a part of the tokens at a time."""
    # texts lie WINDOW empty places apart, so that no window reaches over
    where = np.arange(len(ids)) + np.repeat(np.arange(1, len(lengths) + 1) * WINDOW, lengths)
    wide = np.full(len(ids) + (len(lengths) + 1) * WINDOW, BUCKETS, np.int32)
    wide[where] = ids
    for a in range(WINDOW, len(wide) - WINDOW, 1 << 16):
        b = min(len(wide) - WINDOW, a + (1 << 16))
        vectors = index[wide[a - WINDOW : b + WINDOW]]
        sums = np.concatenate([np.zeros((1, DIM), np.int32), np.cumsum(vectors, axis=0, dtype=np.int32)])
        near = sums[2 * WINDOW + 1 :] - sums[: b - a] - vectors[WINDOW : b - a + WINDOW]
        order = np.argsort(wide[a:b], kind="stable")
        found = wide[a:b][order]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        summed = np.add.reduceat(near[order], first, axis=0)
        inside = found[first] < BUCKETS
        yield found[first][inside], summed[inside]


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(BUCKETS, DIM) unit vectors from all documents; the array's size doesn't depend on them."""
    bounded_batches(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, index = Tokens(), index_vectors()
        total = np.zeros((BUCKETS, DIM), np.float32)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts, 1 << 21):
                ids, lengths = tokens(texts[a:b])
                for some, sums in neighbours(ids, lengths, index):
                    total[some] += sums
        task = TaskContext.get().partitionId()
        some = [i for i in range(0, BUCKETS, PART) if total[i : i + PART].any()]
        yield pa.RecordBatch.from_pydict({"task": pa.array([task // 256] * len(some), pa.int32()), "part": pa.array(some, pa.int32()), "sums": pa.array([total[i : i + PART].tobytes() for i in some], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(PART * DIM)
        for x in sorted(pdf.sums):
            sums += np.frombuffer(x, np.float32)
        return pd.DataFrame({"task": pdf.task[:1], "part": pdf.part[:1], "sums": [sums.astype(np.float32).tobytes()]})

    kind = "task int, part int, sums binary"
    each = docs.select(text_bytes(text).alias("t")).mapInArrow(gather, kind)
    summed = each.groupBy("task", "part").applyInPandas(add, kind).groupBy("part").applyInPandas(add, kind)
    out = np.zeros((BUCKETS, DIM))
    for _, part, sums in summed.collect():
        out[part : part + PART] = np.frombuffer(sums, np.float32).reshape(PART, DIM)
    return (out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32)


def features(ids: np.ndarray, lengths: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's vectors, and the logarithm of its tokens."""
    out = np.zeros((len(lengths), 2 * DIM + 1))
    ends = np.cumsum(lengths)
    for i, (a, b) in enumerate(zip(ends - lengths, ends, strict=True)):
        if b > a:
            sums = squares = 0.0
            for k in range(a, b, 1 << 16):
                x = vectors[ids[k : min(b, k + (1 << 16))]]
                sums, squares = sums + x.sum(0, dtype=float), squares + np.einsum("nd,nd->d", x, x, dtype=float)
            mean = sums / (b - a)
            out[i, :DIM], out[i, DIM : 2 * DIM] = mean, np.sqrt(np.maximum(0, squares / (b - a) - mean**2))
            out[i, -1] = np.log1p(b - a)
    return out


class Network:
    """Standardised features, a hidden layer of rectified units, one logit over a temperature."""

    def __init__(self, params: list[np.ndarray]):
        self.shift, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = params

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature[0], -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        n, d = x.shape
        share = y.mean() if n else 0.0
        params = [x.mean(0) if n else np.zeros(d), (x.std(0) if n else np.ones(d)) + 1e-6, rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(max(share, 1e-9) / max(1 - share, 1e-9))]), np.ones(1)]
        self = cls(params)
        if not 0 < share < 1:
            return self
        order = rng.permutation(n)
        own, rest = order[: n // 6], order[n // 6 :]
        z = (x - self.shift) / self.scale
        m, v, t = [np.zeros_like(p) for p in params[2:6]], [np.zeros_like(p) for p in params[2:6]], 0
        for _ in range(rounds):
            rng.shuffle(rest)
            for a in range(0, len(rest), 128):
                part = rest[a : a + 128]
                h = z[part] @ self.w1 + self.b1
                r = np.maximum(0, h)
                error = (1 / (1 + np.exp(-np.clip(r @ self.w2 + self.b2[0], -30, 30))) - y[part]) / len(part)
                back = np.outer(error, self.w2) * (h > 0)
                grads = [z[part].T @ back, back.sum(0), r.T @ error, np.array([error.sum()])]
                t += 1
                for i, (p, g) in enumerate(zip(params[2:6], grads, strict=True)):
                    g = g + decay * p
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    p -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(own):
            logit = self.logit(x[own])
            loss = lambda k: np.logaddexp(0, -np.where(y[own] > 0, 1, -1) * logit / k).mean()
            self.temperature[0] = min(np.geomspace(0.25, 8, 61), key=loss)
        return self

    def params(self) -> list[np.ndarray]:
        return [self.shift, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature]

    SHAPES = [(2 * DIM + 1,), (2 * DIM + 1,), (2 * DIM + 1, HIDDEN), (HIDDEN,), (HIDDEN,), (1,), (1,)]

    def to_bytes(self) -> bytes:
        return b"".join(p.astype(float).tobytes() for p in self.params())

    @classmethod
    def from_bytes(cls, data: bytes) -> Network:
        if not data:
            return cls.fit(np.zeros((0, 2 * DIM + 1)), np.zeros(0))
        out, at = [], 0
        for shape in cls.SHAPES:
            n = int(np.prod(shape))
            out.append(np.frombuffer(data, float, n, at).reshape(shape))
            at += 8 * n
        return cls(out)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE, fold: int = 0) -> tuple[np.ndarray, bytes]:
    """Word vectors from all documents, and a network from at most ``bound`` labelled rows outside the fold."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIM numbers

    def make() -> Callable[[list[bytes]], list]:
        tokens = Tokens()
        return lambda texts: [list(features(*tokens(texts), shared.value))]

    sample = labelled_sample(docs, labels, label, bound, fold)
    pooled = map_texts(sample, make, "features array<double>", ["doc_id", "target"])

    def learn(rows: pa.Table) -> bytes:
        return Network.fit(np.array(rows.column("features").to_pylist()), rows.column("target").to_numpy().astype(float)).to_bytes()

    return vectors, fit_in_one_task(pooled, learn)


def score(docs: DataFrame, model: tuple[np.ndarray, bytes], keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with ``score``, the calibrated probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[bytes]], list]:
        vectors, data = shared.value
        tokens, network = Tokens(), Network.from_bytes(data)
        return lambda texts: [network.score(features(*tokens(texts), vectors))]

    return map_texts(docs, make, "score double", keep, text)
