"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: words, lower-cased and without signs at their ends, and the words' beginnings. Terms are
hashed to a fixed number of buckets. The machine adds a weight for each term and, through factors, one for each pair of
terms, so that it learns what two words say together. It is fitted by AdaGrad on a bounded sample of labelled rows; a
term takes part if at least ``MIN_DOCS`` of those rows hold it and its share in the two kinds of rows differs by more than
``LEAST_Z`` standard errors, so that the many rare words of long texts don't drown the few that matter; or if it says
something with another term: the rows that hold both have label 1 more or less often, by more than ``PAIR_Z`` standard
errors, than either term alone and the two added up would have it.

Defined results: null and empty texts get the score of no terms at all; repeated rows score alike; without labels of both kinds every
score is the share of label 1 (0 without labels); no documents, no rows; a very long text is one value in one task, in some ten times its size;
further columns, whatever their names, play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm.common import fit_in_one_task, labelled_sample, map_texts

#: Buckets of terms, factors, rows to fit on at most, rows that must hold a term, standard errors.
BUCKETS = 1 << 18
FACTORS = 6
SAMPLE = 20_000
MIN_DOCS = 4
LEAST_Z = 4.0
#: For pairs, of which there are many more: rows that must hold both, standard errors, the share that counts as high, cells of one step's counts, terms whose rows are held as bits at once.
PAIR_DOCS = 8
PAIR_Z = 8.0
HIGH = 0.2
CELLS = 1 << 23
HELD = 1 << 15
SIGNS = b".,;:!?\"'()[]{}<>*#$%&|-_"


def terms(text: bytes) -> np.ndarray:
    """Buckets of a text's distinct terms."""
    words = {w.strip(SIGNS) for w in set(text.lower().split())}
    found = {zlib.crc32(w) for w in words if w}
    found.update(zlib.crc32(w[:6], 1) for w in words if len(w) > 6)
    return np.unique(np.fromiter(found, np.int64, len(found)) % BUCKETS).astype(np.int32)


def telling(texts: list[np.ndarray], target: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Terms whose share in rows with label 1 differs from that in the others beyond chance."""
    ones = np.bincount(np.concatenate([t for t, y in zip(texts, target, strict=True) if y]), minlength=BUCKETS)
    n, n1 = len(target), target.sum()
    p = held / n
    error = np.sqrt(np.maximum(1e-12, p * (1 - p)) * (1 / n1 + 1 / (n - n1)))
    z = np.abs(ones / n1 - (held - ones) / (n - n1)) / error
    return np.flatnonzero((held >= MIN_DOCS) & (z > LEAST_Z))


def counted_pairs(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i of ``left``, j of ``right``: masks of terms) that ``least`` rows or more hold, with the number of these rows."""
    place = np.cumsum(right) - 1
    flat = np.concatenate([np.zeros(0, np.int64), *rows])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    kept = right[flat]
    partner, sizes = place[flat[kept]], np.bincount(of[kept], minlength=len(rows))
    begins = np.cumsum(sizes) - sizes
    lefts, width = np.flatnonzero(left), int(right.sum())
    rows_at_once = max(1, min(256, CELLS // max(1, width)))  # so that counts take some tens of MB, however many terms there are
    order = np.flatnonzero(left[flat])
    order = order[np.argsort(flat[order], kind="stable")]
    bounds = np.searchsorted(flat[order], np.append(lefts[::rows_at_once], len(left)))
    found = []
    for a, (start, end) in enumerate(pairwise(bounds)):
        names, count = lefts[a * rows_at_once : (a + 1) * rows_at_once], 0
        at = order[start:end]
        many = sizes[of[at]]
        for part, n in ((x, y) for c in [np.flatnonzero(np.diff(np.cumsum(many) >> 22)) + 1] for x, y in zip(np.split(at, c), np.split(many, c), strict=True)):
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key = np.repeat(np.searchsorted(names, flat[part]) * width, n) + partner[np.repeat(begins[of[part]], n) + step]
            count = count + np.bincount(key, minlength=len(names) * width)
        key = np.flatnonzero(count >= least) if end > start else np.zeros(0, np.int64)
        if len(key):
            i, j, k = names[key // width], np.flatnonzero(right)[key % width], count[key]
            once = (i < j) | ~(left[j] & right[i])  # what comes from both sides counts from one
            found.append((i[once].astype(np.int32), j[once].astype(np.int32), k[once].astype(np.int32)))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 3


def by_few_terms(i: np.ndarray, j: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the pairs (i, j) in parts that have at most ``HELD`` terms: all at once if they do."""
    if len(np.unique(np.concatenate([i, j]))) <= HELD:
        if len(i):
            yield np.arange(len(i))
        return
    order = np.lexsort((j, i))
    for a in range(0, len(order), HELD // 2):
        yield order[a : a + HELD // 2]


def rows_as_bits(own: np.ndarray, flat: np.ndarray, of_row: np.ndarray, n: int) -> np.ndarray:
    """For each of the sorted terms ``own`` the rows that hold it, as bits."""
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    hit = np.flatnonzero(own[at] == flat)
    hit = hit[np.argsort(at[hit], kind="stable")]
    at, row = at[hit], of_row[hit]
    bits = np.zeros((len(own), (n + 63) // 64), np.uint64)
    some = max(1, CELLS // max(1, n))  # terms whose rows are spread out at once
    for begin in range(0, len(own), some):
        a, b = np.searchsorted(at, (begin, begin + some))
        spread = np.zeros((min(some, len(own) - begin), 64 * bits.shape[1]), bool)
        spread[at[a:b] - begin, row[a:b]] = True
        bits[begin : begin + some] = np.packbits(spread, axis=1, bitorder="little").view(np.uint64)
    return bits


def telling_pairs(texts: list[np.ndarray], target: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Terms of pairs whose rows have label 1 more or less often than the terms by themselves let expect. Equal texts count once.

    Only pairs that can pass are counted: for more, those in ``PAIR_DOCS`` rows with label 1; for less, k rows of an expected
    share q with k q / (1 - q) > ``PAIR_Z`` squared, so both terms are frequent or one has a high share by itself.
    """
    first = np.array(list({t.tobytes(): i for i, t in enumerate(texts)}.values()), np.int64)
    ids = np.flatnonzero(held >= PAIR_DOCS)
    place = np.full(BUCKETS, -1, np.int64)
    place[ids] = np.arange(len(ids))
    rows = [place[texts[i]] for i in first]
    rows = [r[r >= 0] for r in rows]
    y = target[first] > 0
    share = y.mean() if len(y) else 0.0
    told = np.zeros(len(ids), bool)
    if not len(ids) or not 0 < share < 1:
        return ids[told]
    ones = [r for r, one in zip(rows, y, strict=True) if one]
    n = np.bincount(np.concatenate(rows), minlength=len(ids))
    n1 = np.bincount(np.concatenate(ones), minlength=len(ids))
    p = (n1 + share) / (n + 1)  # as if each term had one more row of the mean
    odds, base = np.log(p / (1 - p)), np.log(share / (1 - share))
    # the rows that hold a term, those with label 1 first
    order = ones + [t for t, one in zip(rows, y, strict=True) if not one]
    flat, of_row = np.concatenate(order), np.repeat(np.arange(len(order)), [len(t) for t in order])
    high = p > HIGH
    need = PAIR_Z**2 * (1 - np.minimum(p, HIGH)) / np.minimum(p, HIGH)
    many = n >= PAIR_Z**2 * (1 - HIGH) / HIGH
    carries = high & (n >= PAIR_Z**2 * (1 - p) / p)
    more = counted_pairs(ones, n1 >= PAIR_DOCS, n1 >= PAIR_DOCS, PAIR_DOCS)
    less = [counted_pairs(rows, many & (n >= need), many, int(PAIR_Z**2 * (1 - HIGH) / HIGH)), counted_pairs(rows, carries, np.ones(len(ids), bool), PAIR_DOCS)]
    for given, (i, j, k) in ((True, more), (False, less[0]), (False, less[1])):
        added = 1 / (1 + np.exp(-np.clip(odds[i] + odds[j] - base, -30, 30)))
        alone = np.maximum(p[i], p[j])
        q = np.maximum(added, alone) if given else np.minimum(added, alone)
        can = (i != j) & (k * ((1 - q) / q if given else q / (1 - q)) > PAIR_Z**2)
        i, j, k, q = i[can], j[can], k[can], q[can]
        whole = (len(ones) + 63) // 64
        for few in by_few_terms(i, j):
            own = np.unique(np.concatenate([i[few], j[few]]))
            bits = rows_as_bits(own, flat, of_row, len(order))
            for a in range(0, len(few), 4096):
                part = few[a : a + 4096]
                x, other = bits[np.searchsorted(own, i[part])], bits[np.searchsorted(own, j[part])]
                if given:
                    have, of = k[part], np.bitwise_count(x & other).sum(1)
                else:
                    front = x[:, :whole] & other[:, :whole]
                    if len(ones) % 64:
                        front[:, -1] &= np.uint64((1 << len(ones) % 64) - 1)
                    have, of = np.bitwise_count(front).sum(1), k[part]
                off = (have - of * q[part]) / np.sqrt(of * q[part] * (1 - q[part]) + 1e-9)
                tells = off > PAIR_Z if given else off < -PAIR_Z
                told[i[part][tells]] = told[j[part][tells]] = True
    return ids[told]


class Machine:
    """bias + sum of w_i + sum over pairs of <v_i, v_j> / n, for the n terms with weights that a text holds."""

    def __init__(self, bias: float, ids: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bias, self.ids, self.w, self.v = bias, ids, w, v
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[ids] = np.arange(len(ids))

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.known(texts))[0], -30, 30)))

    def known(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known terms of all texts, and each text's number of them."""
        lengths = np.array([len(t) for t in texts], np.int64)
        at = self.place[np.concatenate(texts)] if lengths.sum() else np.zeros(0, np.int32)
        text = np.repeat(np.arange(len(texts)), lengths)
        return at[at >= 0], np.bincount(text[at >= 0], minlength=len(texts))

    def margin(self, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins, each text's factor sums and each entry's text."""
        text = np.repeat(np.arange(len(lengths)), lengths)
        add = lambda x: np.bincount(text, weights=x, minlength=len(lengths))
        v = self.v[at]
        sums = np.stack([add(v[:, f]) for f in range(v.shape[1])], 1)
        pairs = 0.5 * ((sums**2).sum(1) - add((v**2).sum(1)))
        return self.bias + add(self.w[at]) + pairs / np.maximum(1, lengths), sums, text

    @classmethod
    def fit(cls, texts: list[np.ndarray], target: np.ndarray, rounds: int = 6, rate: float = 0.1, shrink: float = 1e-4, seed: int = 7) -> Machine:
        share = float(target.mean()) if len(target) else 0.0
        bias = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        held = np.bincount(np.concatenate(texts), minlength=BUCKETS) if texts else np.zeros(BUCKETS, int)
        ids = np.union1d(telling(texts, target, held), telling_pairs(texts, target, held)) if 0 < share < 1 else np.zeros(0, int)
        rng = np.random.default_rng(seed)
        self = cls(float(bias), ids, np.zeros(len(ids)), rng.normal(0, 0.02, (len(ids), FACTORS)))
        seen_w, seen_v = np.full(len(ids), 1e-3), np.full(self.v.shape, 1e-3)
        for _ in range(rounds if len(ids) else 0):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), 64):
                part = order[a : a + 64]
                at, lengths = self.known([texts[i] for i in part])
                margin, sums, text = self.margin(at, lengths)
                error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target[part]
                some, inverse = np.unique(at, return_inverse=True)
                g = error[text]
                gw = np.bincount(inverse, weights=g) + shrink * self.w[some]
                seen_w[some] += gw**2
                self.w[some] -= rate * gw / np.sqrt(seen_w[some])
                gv = (g / np.maximum(1, lengths)[text])[:, None] * (sums[text] - self.v[at])
                gv = np.stack([np.bincount(inverse, weights=gv[:, f]) for f in range(FACTORS)], 1) + shrink * self.v[some]
                seen_v[some] += gv**2
                self.v[some] -= rate * gv / np.sqrt(seen_v[some])
        return self

    def to_bytes(self) -> bytes:
        return b"".join([np.array([self.bias]).tobytes(), np.array([len(self.ids)], np.int64).tobytes(), self.ids.astype(np.int32).tobytes(), self.w.astype(np.float32).tobytes(), self.v.astype(np.float32).tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> Machine:
        if not data:
            return cls(-30.0, np.zeros(0, int), np.zeros(0), np.zeros((0, FACTORS)))
        bias, n = np.frombuffer(data, float, 1)[0], int(np.frombuffer(data, np.int64, 1, 8)[0])
        ids, w = np.frombuffer(data, np.int32, n, 16), np.frombuffer(data, np.float32, n, 16 + 4 * n)
        return cls(float(bias), ids, w.astype(float), np.frombuffer(data, np.float32, n * FACTORS, 16 + 8 * n).reshape(n, FACTORS).astype(float))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE, fold: int = 0) -> bytes:
    """A model from at most ``bound`` labelled rows outside the fold; at most 8 MB, whatever the corpus."""
    sample = labelled_sample(docs, labels, label, bound, fold)
    held = map_texts(sample, lambda: lambda texts: [[terms(t) for t in texts]], "terms array<int>", ["doc_id", "target"])

    def learn(rows: pa.Table) -> bytes:
        target = rows.column("target").to_numpy().astype(float)
        return Machine.fit([np.asarray(x, np.int64) for x in rows.column("terms").to_pylist()], target).to_bytes()

    return fit_in_one_task(held, learn)


def score(docs: DataFrame, model: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with ``score``, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS weights and factors

    def make() -> Callable[[list[bytes]], list]:
        machine = Machine.from_bytes(shared.value)
        return lambda texts: [machine.score([terms(t) for t in texts])]

    return map_texts(docs, make, "score double", keep, text)
