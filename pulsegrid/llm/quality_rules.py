"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the word windows that a text repeats; a text is rejected
if too many of its characters lie inside repeated windows or repeated lines.

Defined results: a null or empty text has no words, fails the base rule and is not kept; repeated rows
are judged row by row; a text of any length is read whole (memory grows with the longest text only).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from pulsegrid.llm.common import map_texts

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: An odd multiplier of the rolling hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Rules:
    """Limits, in hundredths of a text's word characters, on what repeats (first occurrences don't count)."""

    min_words: int = 20
    repeat_window: int = 8
    repeat_words_pct: int = 30
    ngram_chars_pct: dict[int, int] = field(default_factory=lambda: {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10})
    line_chars_pct: int = 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter integers over 64 bits."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n modulo 2^64."""
    x = np.full(n + 1, base, np.uint64)
    x[0] = 1
    return np.cumprod(x)


class Windows:
    """Repeated word windows of several texts at once, by one rolling hash for all window lengths."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray):
        self.ids, self.doc, n = ids, doc, len(ids)
        with np.errstate(over="ignore"):
            power, self.unpower = powers(BASE, n), powers(INVERSE, n)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(ids) * power[:n], dtype=np.uint64)])
            self.salt = mixed(doc + (1 << 40))

    def repeats(self, n: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Two flags for each word: a window of n words that starts there occurs in the same text again or before; before.

        among: the first flag for a smaller n; a window can only repeat where its beginning does.
        """
        count = len(self.ids)
        every, later = np.zeros(count, bool), np.zeros(count, bool)
        if count < n:
            return every, later
        inside = self.doc[: count - n + 1] == self.doc[n - 1 :]
        at = np.flatnonzero(inside if among is None else inside & among[: count - n + 1])
        with np.errstate(over="ignore"):
            keys = (self.sums[at + n] - self.sums[at]) * self.unpower[at] + self.salt[at]
        order = np.argsort(keys, kind="stable")
        same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        a, b = at[order[same]], at[order[same + 1]]
        if len(a) and not ((self.doc[a] == self.doc[b]).all() and all((self.ids[a + j] == self.ids[b + j]).all() for j in range(n))):
            # two different windows with one hash: compare the windows themselves
            rows = np.column_stack([self.doc[at], *(self.ids[at + j] for j in range(n))])
            _, group = np.unique(rows, axis=0, return_inverse=True)
            order = np.argsort(group, kind="stable")
            same = np.flatnonzero(group[order[1:]] == group[order[:-1]])
            a, b = at[order[same]], at[order[same + 1]]
        every[a] = every[b] = later[b] = True
        return every, later

    def covered(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Which words lie inside the windows of n words that start where ``starts`` is set."""
        c = np.concatenate([np.zeros(n, np.int64), np.cumsum(starts)])
        return c[n:] > c[:-n] if len(starts) else starts


def measure(texts: list[bytes], rules: Rules) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars and, for each n-gram length, the
    characters inside repeats, for each text."""
    docs = len(texts)
    whole = b"\n".join(texts)
    data = np.frombuffer(whole + b"\n", np.uint8)
    doc_end = np.cumsum([len(t) + 1 for t in texts])
    word = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word])))
    starts, ends = edge[::2], edge[1::2]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    doc = np.searchsorted(doc_end, starts, side="right")
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in whole.split()), np.int64, len(starts))
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=docs).astype(np.int64)
    symbols = np.add.reduceat(SYMBOL[data], np.concatenate([[0], doc_end[:-1]]), dtype=np.int64)

    dup_lines, dup_chars = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    upto = np.concatenate([[0], np.cumsum(chars)])
    at = 0
    for i, t in enumerate(texts):
        seen: set[bytes] = set()
        for line in t.split(b"\n"):
            if line in seen and not line.isspace() and line:
                a, b = np.searchsorted(starts, (at, at + len(line)))
                dup_lines[i] += 1
                dup_chars[i] += upto[b] - upto[a]
            seen.add(line)
            at += len(line) + 1

    windows = Windows(ids, doc)
    every, inside = None, {}
    for n in sorted({rules.repeat_window, *rules.ngram_chars_pct}):
        every, later = windows.repeats(n, every)
        inside[n] = per_doc(chars * windows.covered(later, n))
        if n == rules.repeat_window:
            repeat_words = per_doc(windows.covered(every, n))
    return [np.bincount(doc, minlength=docs), per_doc(chars), symbols, dup_lines, repeat_words, dup_chars, *(inside[n] for n in rules.ngram_chars_pct)]


def judge(texts: list[bytes], rules: Rules) -> list[np.ndarray]:
    words, chars, symbols, dup_lines, repeat_words, dup_chars, *inside = measure(texts, rules)
    failed = (words < rules.min_words) | (100 * repeat_words > rules.repeat_words_pct * words)
    kept = ~failed & (100 * dup_chars <= rules.line_chars_pct * chars)
    for covered, most in zip(inside, rules.ngram_chars_pct.values(), strict=True):
        kept &= 100 * covered <= most * chars
    return [words, chars, symbols, dup_lines, repeat_words, failed, kept, dup_chars]


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long"


def quality_rules(docs: DataFrame, keep: list[str], rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with the figures and the verdict for its whole text; no shuffle."""
    return map_texts(docs, lambda: lambda texts: judge(texts, rules), SCHEMA, keep, text)
