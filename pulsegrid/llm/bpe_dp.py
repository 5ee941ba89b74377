"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Byte-pair encoding has two properties that make it a dynamic program. The tokens of a text's part between two token borders are the
encoding of that part, so the last token of each prefix says all: what precedes it is the encoding of a shorter prefix. And a sequence
of tokens is an encoding if each token encodes itself and each pair of neighbours does. So of all tokens that end a prefix exactly one is
compatible with the last token of the prefix before it; that one is stored, and the ids follow from the back-pointers. The time grows
with the length of a word, not with its square, however long it is.

Tokens that end a prefix come from a suffix automaton of the whole vocabulary: its state after some letters is the
longest end of them that occurs anywhere in a token, and its suffix links lead to all shorter ends; a token is the longest text
of just one state, which is marked. Two tokens are compatible unless a merge across their border comes first, which is tested by
undoing merges from the later to the earlier one.

A worker builds the automaton once from the vocabulary file, whose path is a parameter. Texts are normalised and
split as the file says; each new word goes through the dynamic program, and recent words' ids are kept, bounded by bytes. Fit for
files of plain merges: each token from one merge of earlier tokens, no dropout, prefix, byte fallback or unknown token. Others are refused.

Defined results: null and empty texts have no ids, and no ids decode to the empty text; the file's special tokens are found in raw
texts as the tokenizers library does it; repeated rows are encoded each; no documents, no rows; a very long text is one value in one task, in
some tens of times its size if it is one word; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded_batches, map_texts
from pulsegrid.llm.packing import WordTokenizer

#: Results of pair tests that a worker keeps.
PAIRS = 1 << 19


class SuffixAutomaton:
    """The factors of all given words: transitions, suffix links, the length of each state's longest text, and which word that is, if it is one."""

    def __init__(self, words: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.whole = [-1], [0], [-1]
        for k, word in enumerate(words):
            state = 0
            for symbol in word:
                state = self.extend(state, symbol)
            self.whole[state] = k

    def add(self, length: int, onward: dict[int, int], link: int) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.length.append(length)
        self.whole.append(-1)
        return len(self.link) - 1

    def clone(self, state: int, via: int, symbol: int) -> int:
        """Split off the texts of a state that are at most one longer than those of ``via``."""
        new = self.add(self.length[via] + 1, dict(self.next[state]), self.link[state])
        self.link[state] = new
        while via >= 0 and self.next[via].get(symbol) == state:
            self.next[via][symbol] = new
            via = self.link[via]
        return new

    def extend(self, last: int, symbol: int) -> int:
        """The state of the word that ``last`` stands for and one more symbol."""
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self.clone(known, last, symbol)
        new = self.add(self.length[last] + 1, {}, 0)
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            known = self.next[last][symbol]
            self.link[new] = known if self.length[known] == self.length[last] + 1 else self.clone(known, last, symbol)
        return new


class PrefixEncoder:
    """Ids of single words by the last token of each prefix.

    Tokens are numbered by age here: first those that no merge makes, then one for each merge, so a later merge has a larger number.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str):
        made = {a + b for a, b in merges}
        names = [t for t in vocabulary if t not in made]
        number = {t: k for k, t in enumerate(names)}
        self.base = len(names)
        self.halves: list[tuple[int, int]] = [(-1, -1)] * self.base
        spelt = [[k] for k in range(self.base)]
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a not in number or b not in number or a + b in number:
                raise ValueError("each token must come from one merge of earlier tokens")
            pair = number[a], number[b]
            self.merged[pair] = number[a + b] = len(names)
            names.append(a + b)
            self.halves.append(pair)
            spelt.append(spelt[pair[0]] + spelt[pair[1]])
        self.id = [vocabulary[t] for t in names]
        self.length = [len(s) for s in spelt]
        self.symbol = {t: number[t] for t in names[: self.base]}
        self.end = end
        # a token encodes itself if its halves do and no merge across their border comes before its own
        self.itself = [True] * self.base
        for k in range(self.base, len(names)):
            a, b = self.halves[k]
            self.itself.append(self.itself[a] and self.itself[b] and self.compatible(a, b, k))
        # for each state the longest token that ends there, of those that encode themselves; and for each token the next shorter one
        found = self.automaton = SuffixAutomaton(spelt)
        self.ends, self.shorter = [-1] * len(found.link), [-1] * len(names)
        for state in sorted(range(1, len(found.link)), key=found.length.__getitem__):
            token, below = found.whole[state], self.ends[found.link[state]]
            self.ends[state] = token if token >= 0 and self.itself[token] else below
            if token >= 0:
                self.shorter[token] = below
        self.below = [-1, *(self.ends[up] for up in found.link[1:])]
        self.tested: dict[int, bool] = {}

    def compatible(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether no merge across the border of two tokens comes before both are whole (or before a later merge).

        Merges are undone from the latest on; of two equal ones the right is the later, since the leftmost goes first.
        """
        limit = len(self.halves) if before is None else before
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.halves[a][1]
            elif b >= self.base:
                limit, b = b + 1, self.halves[b][0]
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """The ids of a word, given in the file's byte alphabet."""
        if not word:
            return []
        symbol = self.symbol
        text = [symbol[c] for c in word[:-1]]
        text.append(symbol[word[-1] + self.end])
        onward, link, longest, length = self.automaton.next, self.automaton.link, self.automaton.length, self.length
        ends, below, shorter, tested = self.ends, self.below, self.shorter, self.tested
        last, state, matched = [0] * (len(text) + 1), 0, 0
        for i, c in enumerate(text, 1):
            after = onward[state].get(c)
            while after is None:
                state = link[state]
                matched = longest[state]
                after = onward[state].get(c)
            state, matched = after, matched + 1
            # the state's own longest text is met only if all of it is; its shorter ends always are
            token = ends[state] if matched == longest[state] else below[state]
            before = i - length[token]
            while before:
                pair = last[before] << 32 | token
                fine = tested.get(pair)
                if fine is None:
                    if len(tested) >= PAIRS:
                        tested.clear()
                    fine = tested[pair] = self.compatible(last[before], token)
                if fine:
                    break
                token = shorter[token]
                before = i - length[token]
            last[i] = token
        ids, i = [], len(text)
        while i:
            ids.append(self.id[last[i]])
            i -= length[last[i]]
        return ids[::-1]


class PrefixTokenizer(WordTokenizer):
    """Whole texts as the file's library encodes them without adding special tokens, each word by ``PrefixEncoder``."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        model, added = settings["model"], settings["added_tokens"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [t["content"] for t in added if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"only plain byte-pair encoding is known, without {odd}")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in added}
        vocabulary = {t: k for t, k in model["vocab"].items() if t not in special}
        self.encoder = PrefixEncoder(vocabulary, merges, model["end_of_word_suffix"] or "")
        self.special = special
        self.at_special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")
        self.names = {**{k: t for t, k in vocabulary.items()}, **{k: t for t, k in special.items()}}

    def part_ids(self, letters: str) -> list[int]:
        return self.encoder.encode(letters)

    def full(self, text: str) -> bytes:
        ids, at = array("I"), 0
        for found in [*self.at_special.finditer(text), None]:
            between = text[at : found.start() if found else len(text)]
            if between:
                if self.whole.normalizer:
                    between = self.whole.normalizer.normalize_str(between)
                pieces = self.whole.pre_tokenizer.pre_tokenize_str(between) if self.whole.pre_tokenizer else [(between, None)]
                for piece, _ in pieces:
                    ids.extend(self.encoder.encode(piece))
            if found:
                ids.append(self.special[found[0]])
                at = found.end()
        return ids.tobytes()

    def decode(self, ids: list[int]) -> str:
        """What the library's decode gives without skipping special tokens: ids that the file doesn't have are left out."""
        tokens = [t for t in map(self.names.get, ids) if t is not None]
        return self.whole.decoder.decode(tokens) if self.whole.decoder else " ".join(tokens)


@functools.lru_cache(maxsize=1)
def tokenizer(path: str) -> PrefixTokenizer:
    """Built once by each worker and file."""
    return PrefixTokenizer(path)


def id_lists(encoded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(e) // 4 for e in encoded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)))


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", decoded: bool = False) -> DataFrame:
    """The ``keep`` columns and ids (array of int) of each whole text; if asked for, also ``decoded``, the text that the ids give back."""

    def make() -> Callable[[list[bytes]], list]:
        one = tokenizer(path)

        def run(texts: list[bytes]) -> list:
            encoded = [one.encode(t) for t in texts]
            said = [pa.array([one.decode(array("I", e).tolist()) for e in encoded], pa.string())] if decoded else []
            return [id_lists(encoded), *said]

        return run

    return map_texts(docs, make, "ids array<int>, decoded string" if decoded else "ids array<int>", keep, text, 1 << 21)


def decode(encoded: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The ``keep`` columns and the decoded text of each row's ids (null: none)."""
    bounded_batches(encoded.sparkSession)
    rows = encoded.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    kept = [f"k{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tokenizer(path)
        for batch in batches:
            lists = batch.column(len(keep))
            places, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            texts = [one.decode(values[a:b].tolist()) for a, b in zip(places[:-1], places[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*batch.schema.names[: len(keep)], "decoded"])

    made = rows.mapInArrow(run, ", ".join([*kept, "decoded string"]))
    return made.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "decoded")
