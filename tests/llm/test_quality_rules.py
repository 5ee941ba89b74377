from __future__ import annotations

import random
from collections import Counter

from pulsegrid.llm.quality_rules import Rules, judge, quality_rules

RULES = Rules()


def split(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text: str | None) -> tuple:
    text = text or ""
    w = split(text)
    chars = sum(map(len, w))

    def inside(n: int, first_too: bool) -> list[bool]:
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        many, seen, out = Counter(grams), set(), [False] * len(w)
        for i, g in enumerate(grams):
            if many[g] > 1 and (first_too or g in seen):
                out[i : i + n] = [True] * n
            seen.add(g)
        return out

    seen, dups, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if split(line) and line in seen:
            dups += 1
            dup_chars += sum(map(len, split(line)))
        seen.add(line)
    repeat = sum(inside(8, True))
    failed = len(w) < 20 or 100 * repeat > 30 * len(w)
    fine = 100 * dup_chars <= RULES.line_chars_pct * chars
    for n, most in RULES.ngram_chars_pct.items():
        fine = fine and 100 * sum(len(x) for x, c in zip(w, inside(n, False), strict=True) if c) <= most * chars
    return len(w), chars, sum(c in "#*$%&|<>" for c in text), dups, repeat, failed, fine and not failed


def texts() -> list[str | None]:
    rng = random.Random(1)
    out: list[str | None] = [None, "", " ", "\n\n", "a\na\na", "é " * 30, "x\x0by\x0cz", "#*$%&|<>" * 3]
    for _ in range(120):
        size, many = rng.randint(2, 400), rng.choice([3, 10, 60, 2000])
        words = [rng.choice(["ä", "w"]) + str(rng.randrange(many)) for _ in range(size)]
        if rng.random() < 0.5:
            a = rng.randrange(size)
            words += words[a : a + rng.randint(1, 40)] * rng.randint(1, 3)
        out.append("".join(x + rng.choice([" ", " ", " ", "\n", "\t ", " "]) for x in words))
    lines = ["one line of text here", "another line of text there", "third line"]
    out.append("\n".join(rng.choice(lines) for _ in range(30)))
    out.append(" ".join(f"word{i}" for i in range(60_000)))
    return out


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = quality_rules(df, ["doc_id"]).drop("dup_line_chars").collect()
    want = {i: brute(t) for i, t in rows}
    assert {r[0]: tuple(r)[1:] for r in got} == want
    assert {w[-1] for w in want.values()} == {True, False}


def test_texts_judged_together_or_alone_are_judged_alike():
    some = [(t or "").encode() for t in texts()[:60]]
    together = [x.tolist() for x in map(lambda c: c, judge(some, RULES))]
    for i, t in enumerate(some):
        assert [x[i] for x in together] == [x.tolist()[0] for x in judge([t], RULES)]


def test_clashing_names_repeated_rows_and_empty_table(spark):
    schema = "doc_id long, text string, n_words int, kept string"
    df = spark.createDataFrame([(1, "a b", 7, "x"), (1, "a b", 7, "x"), (None, None, None, None)], schema)
    assert sorted((tuple(r)[:2] for r in quality_rules(df, ["doc_id"]).collect()), key=repr) == [(1, 2), (1, 2), (None, 0)]
    assert quality_rules(spark.createDataFrame([], schema), ["doc_id"]).count() == 0
