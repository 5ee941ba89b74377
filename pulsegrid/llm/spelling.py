"""Spelling variants: words at one edit from a much more frequent word, found by a rare-first q-gram prefix filter.

Bigrams of all words are ordered by how many words hold them, the rarest first; a word's prefix is its three rarest bigrams, places
breaking ties. One edit touches at most two bigrams, so of two words at one edit the first untouched bigram in that order
is in the prefix of both. (If the prefixes end at different bigrams, the untouched one of the earlier prefix lies before the end of the later;
if they end at the same bigram, untouched copies of it keep their order, so the first of them is in both.) Such a bigram has
the edit to its right, then it stands at the same place from the start and both words agree up to its end, or to its left, then at the same place
from the end, and they agree from its start on. The rest of the word is cut in the middle of the shorter one, and the edit
lies in one half, so the other half agrees too. A word thus gives a few keys for each of its three bigrams: side, place, and a hash of
what must agree; words meet by an equi-join on a key, and each pair met is verified by its edit distance. Words of equal
length meet among themselves, shorter ones meet words one longer.

Keys of common beginnings don't pile up: what must agree is about half of the word besides the bigram. All is joined as
DataFrames; the only thing every task sees is the order of the bigrams, at most the square of the alphabet's 90 letters. Joins are
hinted to merge, so that no table goes through the driver: Spark guesses the keys' size by that of the words, as if each had one, and would broadcast them.

Chains of forms are followed by pointer jumping: a form is at least ``ratio`` times as frequent as its word, so a chain's length is
bounded by the logarithm of the largest count, and the rounds by the logarithm of that.

Defined results: null and empty texts hold no words; a null id counts as empty text; repeated rows are counted each; ties go to
the smallest form in code-point order; no words, no rows; a very long text is one value in one task, and a very long run of letters is a
word like any other; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded_batches, cut, remove, text_bytes, write_table

#: A run's letters after lower-casing A-Z, and their number.
LETTERS = "a-zÀ-ÿ"
ALPHABET = [*map(chr, range(ord("a"), ord("z") + 1)), *map(chr, range(0xC0, 0x100))]
#: Bigrams of a prefix: those that one edit can touch, and one more.
PREFIX = 3
#: Letters of a rest up to which it isn't cut in two.
SHORT = 2
#: Words that a task counts before it hands them on.
HELD = 400_000

Q = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
Q_INVERSE = np.uint64(pow(int(Q), -1, 1 << 64))


def count_words(docs: DataFrame, min_chars: int = 5, doc_id: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """(word, n): the runs of letters with at least ``min_chars`` code points, one letter deleted where ``every`` divides the checksum of id and run."""
    bounded_batches(docs.sparkSession)
    run_of = re.compile(f"[{LETTERS}]{{{min_chars},}}")  # greedy, so these are whole runs

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        crc = zlib.crc32
        for batch in batches:
            for id_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = crc(id_ + b":")
                for word, n in Counter(run_of.findall(t.lower().decode())).items():  # lower() of bytes changes A-Z alone
                    h = crc(word.encode(), start)
                    if h % every == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < min_chars:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield flush(held)
                    held = Counter()
        if held:
            yield flush(held)

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary").alias("id"), text_bytes(text).alias("t"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bigram_order(words: DataFrame) -> np.ndarray:
    """The rank of each bigram (first letter's place * letters + second's) in the order of the number of words that hold it."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(places, lambda i: F.substring("word", i, F.lit(2)))).alias("gram")).groupBy("gram").count()
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = np.zeros(len(ALPHABET) ** 2, np.int64)
    for gram, n in grams.collect():  # at most 90 * 90 rows
        counts[place[gram[0]] * len(ALPHABET) + place[gram[1]]] = n
    order = np.empty(len(counts), np.int32)
    order[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts), dtype=np.int32)
    return order


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SAME, SHORTER, LONGER = 0, 1, 2


def prefix_keys(words: list[str], order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's place, role, key) of each key: role is SAME, SHORTER or LONGER of the pair that it looks for."""
    code = np.zeros(256, np.int64)
    code[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
    letters = code[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    length = np.array([len(w) for w in words], np.int64)
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    word = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(letters)) - start[word]
    with np.errstate(over="ignore"):
        powers, back = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(length.max()) + 1, q, np.uint64))), dtype=np.uint64) for q in (Q, Q_INVERSE))
        sums = np.concatenate(([np.uint64(0)], np.cumsum((letters + 1).astype(np.uint64) * powers[at], dtype=np.uint64)))

        # the three rarest bigrams of each word
        inner = np.flatnonzero(at < length[word] - 1)
        rank = order[letters[inner] * len(ALPHABET) + letters[inner + 1]]
        sort = np.lexsort((at[inner], rank, word[inner]))
        nth = np.arange(len(inner)) - np.concatenate(([0], np.cumsum(length - 1)[:-1]))[word[inner[sort]]]
        chosen = inner[sort[nth < PREFIX]]
        w, p = word[chosen], at[chosen]
        full = length[w]

        def head(k: np.ndarray, i: np.ndarray) -> np.ndarray:  # hash of the first k letters of word i
            return sums[start[i] + k] - sums[start[i]]

        def tail(k: np.ndarray, i: np.ndarray) -> np.ndarray:  # of the last k
            end = start[i] + length[i]
            return (sums[end] - sums[end - k]) * back[length[i] - k]

        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        for side, (near, far, agreed) in enumerate(((head, tail, p + 2), (tail, head, full - p))):
            for role in (SAME, SHORTER, LONGER):
                least = full - (role == LONGER)  # letters of the pair's shorter word
                rest = least - agreed
                fine = rest >= (role == SAME)
                i, e, n, r = w[fine], agreed[fine], least[fine], rest[fine]
                half = e + (r + 1) // 2
                tag = np.uint64(8 * side + 4 * (role != SAME))

                def key(kind: int, mask: np.ndarray, *hashes: np.ndarray, tag=tag, e=e, n=n) -> np.ndarray:
                    x = mixed((n[mask].astype(np.uint64) << np.uint64(32)) + (e[mask].astype(np.uint64) << np.uint64(4)) + tag + np.uint64(kind))
                    for h in hashes:
                        x = mixed(x ^ h) + Q
                    return x

                whole, cut_up = r <= SHORT, r > SHORT
                found.append((i[whole], role, key(0, whole, near(e[whole], i[whole]))))
                a, b = i[cut_up], half[cut_up]
                found.append((a, role, key(1, cut_up, near(b, a))))
                found.append((a, role, key(2, cut_up, near(e[cut_up], a), far(n[cut_up] - b, a))))
    return (
        np.concatenate([x for x, _, _ in found]),
        np.concatenate([np.full(len(x), role, np.int8) for x, role, _ in found]),
        np.concatenate([k for _, _, k in found]).view(np.int64),
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all pairs of ``words`` (word, n) at exactly one inserted, deleted or replaced code point, in both directions."""
    order = bigram_order(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                place, role, key = prefix_keys(batch.column(0).to_pylist(), order)
                place = pa.array(place)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), batch.column(0).take(place), batch.column(1).take(place)], ["key", "role", "word", "n"])

    keys = words.select("word", "n").mapInArrow(run, "key long, role byte, word string, n long")
    left = keys.where(F.col("role") != LONGER).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = keys.where(F.col("role") != SHORTER).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = left.join(right.hint("merge"), (left["key"] == right["key"]) & ((F.length("a") != F.length("b")) | (F.col("a") < F.col("b"))))
    met = met.where(F.levenshtein("a", "b", 1) == 1).groupBy("a", "b").agg(F.any_value("a_n").alias("a_n"), F.any_value("b_n").alias("b_n"))
    both = (F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba"))
    return met.select(F.inline(F.array(*both)))


def last_forms(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root) for links (word, form) without cycles: where following them ends."""
    spark, now = links.sparkSession, links.select("word", F.col("form").alias("root"))
    path = write_table(now, "roots")
    for _ in range(max_rounds):
        now = spark.read.schema(now.schema).parquet(path)
        onward = now.select(F.col("word").alias("via"), F.col("root").alias("end")).hint("merge")
        if onward.join(now, now["root"] == onward["via"], "left_semi").isEmpty():
            return now
        stepped = now.join(onward, now["root"] == onward["via"], "left").select("word", F.coalesce("end", "root").alias("root"))
        new = write_table(stepped, "roots")
        remove(spark, path)
        path = new
    raise RuntimeError("forms did not settle")


def variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words with at least ``min_chars`` code points and ``min_count`` occurrences."""
    if min_chars < PREFIX + 1 or ratio < 2:
        raise ValueError("words need four code points and a form twice the count of its word")
    words = cut(count_words(docs, min_chars, doc_id, text).where(F.col("n") >= min_count), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    around = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    fits = -F.col("best.minus") >= ratio * F.col("n")
    found = words.join(around.hint("merge"), "word", "left").select(
        "word",
        F.when(fits, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("best.minus")).alias("form_n"),
    )
    found = cut(found, "variants")
    roots = last_forms(found.where("form IS NOT NULL"))
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
