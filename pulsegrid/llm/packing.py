"""Best-fit packing of token sequences.

Each text becomes token ids with an end id; only texts longer than a sequence are cut, into whole sequences and a
rest. Pieces are dealt by a hash into groups of bounded size, and each group is packed by best-fit decreasing: a
segment tree over remaining capacities finds the tightest open sequence in logarithmic time. A group leaves at most
a few sequences partly empty more than one global packing would, and no task sees more than one group's lengths.
Token ids never travel: only lengths and checksums are shuffled.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; ties of equal length go by
id, piece and checksum, so a rerun of a lost task packs alike; no documents, no rows; a very long text is one value in one task, in some ten times its size; further columns,
whatever their names, play no part.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut, map_texts

#: Pieces that a group is sized for.
GROUP = 20_000
#: Bytes of a worker's cache of words, and what an entry takes besides its letters and ids.
CACHE, ENTRY = 64 << 20, 220


class Recent(dict):
    """A cache that makes what it lacks and keeps the latest entries of ``CACHE`` to twice as many bytes; a longer key isn't kept."""

    def __init__(self, make: Callable, most: int = CACHE):
        self.make, self.most, self.held, self.old = make, most, 0, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        size = ENTRY + 5 * len(key)  # a key and at most one id for each of its bytes
        if size > self.most:
            return found
        if self.held + size > self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += size
        self[key] = found
        return found


class WordTokenizer:
    """Token ids of whole texts by a tokenizer that treats white space as a mere word break.

    Such a tokenizer encodes a text as it encodes its words one by one, so words are looked up in a cache, and only
    new words reach the tokenizer. Words of plain letters and signs are split as the tokenizer's own pattern does and
    each part goes to its BPE model directly; all others (special tokens, marks, other scripts) take its full path.
    That holds for a file whose normalizer and splitting are ``KNOWN``; with any other file, whole texts take the full path.
    """

    #: Normal form C, white space as one blank, lower case; words, digits and signs apart, as bytes.
    KNOWN = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    }

    #: Characters that normal form C and lower-casing treat one by one, and the parts of words made of them.
    PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ž]+")
    PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:\W|_)+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        self.by_word = all(settings[k] == v for k, v in self.KNOWN.items()) and settings["model"]["type"] == "BPE" and not any(t["lstrip"] or t["rstrip"] for t in settings["added_tokens"])
        self.tokenize = self.whole.model.tokenize
        # byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.alphabet = {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}
        self.parts, self.words = Recent(self.part), Recent(self.word)

    def part_ids(self, letters: str) -> list[int]:
        return [t.id for t in self.tokenize(letters)]

    def full(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
        return array("I", self.part_ids(letters)).tobytes()

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if not self.PLAIN.fullmatch(text) or "<|" in text:
            return self.full(text)
        text = text.lower()
        if text.isalpha():
            return self.parts[text]
        if text[:-1].isalpha():
            return self.parts[text[:-1]] + self.parts[text[-1]]
        return b"".join(map(self.parts.__getitem__, self.PART.findall(text)))

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text, four bytes each, lowest first."""
        if not self.by_word:
            return self.full(text.decode())
        return b"".join(map(self.words.__getitem__, text.split()))


class CapacityTree:
    """A segment tree over remaining capacities 0 to ``most``; a leaf holds the open sequences with that capacity."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least ``length`` that has an open sequence."""
        node = length + self.size
        if self.count[node]:
            return length
        while node > 1:  # up to the first right neighbour that has any, then down its left side
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None

    def take(self, capacity: int) -> int:
        self._change(capacity, -1)
        return self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length; ``lengths`` must fall."""
    tree, sequences = CapacityTree(most), 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        capacity = tree.tightest(n) if n < most else None
        if capacity is None:
            at, capacity, sequences = sequences, most, sequences + 1
        else:
            at = tree.take(capacity)
        sequence[i], offset[i] = at, most - capacity
        if capacity > n:
            tree.put(capacity - n, at)
    return sequence, offset


def pieces(docs: DataFrame, keep: list[str], encoder: Callable[[], Callable[[bytes], bytes]], most: int, end_id: int = 0, text: str = "text") -> DataFrame:
    """The ``keep`` columns with piece, start, length and ids_crc32 for each piece of every row."""
    end = np.array([end_id], "<u4").tobytes()

    def make() -> Callable[[list[bytes]], list]:
        encode = encoder()

        def run(texts: list[bytes]) -> list:
            out = []
            for t in texts:
                ids = encode(t) + end
                out.append([(k // (4 * most), k // 4, len(p := ids[k : k + 4 * most]) // 4, zlib.crc32(p)) for k in range(0, len(ids), 4 * most)])
            return [pa.array([[dict(zip(("piece", "start", "length", "crc"), x, strict=True)) for x in row] for row in out], KIND)]

        return run

    rows = map_texts(docs, make, "pieces array<struct<piece:int,start:long,length:long,crc:long>>", keep, text)
    rows = rows.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.explode("pieces").alias("p"))
    return rows.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "p.piece", "p.start", "p.length", F.col("p.crc").alias("ids_crc32"))


KIND = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]))


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", most: int = 2048, end_id: int = 0, text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""

    def encoder() -> Callable[[bytes], bytes]:
        return WordTokenizer(path).encode

    cut_up = cut(pieces(docs, [doc_id], encoder, most, end_id, text).withColumnRenamed(doc_id, "id"), "pieces")
    return assign(cut_up, most).withColumnRenamed("id", doc_id)


def assign(cut_up: DataFrame, most: int, groups: int | None = None) -> DataFrame:
    """Add sequence_id and offset to pieces (id, piece, start, length, ids_crc32)."""
    groups = groups or max(1, -(-cut_up.count() // GROUP))
    kind = cut_up.schema["id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = best_fit_decreasing(pdf.length.to_numpy(), most)
        return pdf.assign(sequence_id=pdf["group"] * (1 << 32) + sequence, offset=offset).drop(columns="group")

    # a row's place among the written pieces goes into the hash, so a row that repeats many times is dealt out too; the file's rows keep their places if a task is repeated
    place = F.monotonically_increasing_id()
    dealt = cut_up.withColumn("group", F.pmod(F.xxhash64("id", "piece", "ids_crc32", place), F.lit(groups)))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("group").applyInPandas(run, schema)
