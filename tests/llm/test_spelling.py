from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from pulsegrid.llm import spelling
from pulsegrid.llm.queries import QUERIES
from tests.conftest import DATA


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(docs: list[tuple]) -> list[tuple]:
    counts: Counter = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    around = {w: set() for w in n}
    for w in n:  # words at one edit lie among the words with the same text after some deletion
        around[w] = set()
    gaps: dict[str, set] = {}
    for w in n:
        for g in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            gaps.setdefault(g, set()).add(w)
    for met in gaps.values():
        for a in met:
            around[a] |= {b for b in met if b != a and near(a, b)}
    form = {}
    for w in n:
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return sorted(rows)


def test_query_against_deletion_neighbourhoods(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_spelling"](spark, f"{DATA}/sf0.001").collect())) == by_hand(docs)


def test_dense_words_nulls_ties_repeats_and_clashing_names(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abÿ") for _ in range(rng.randint(4, 9))) for _ in range(500)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÀÀÀÀÀÀ", "àÀÀÀÀÀ", "×÷×÷×", "x" * 5000, "x" * 4999]
    docs = [(rng.choice([None, *range(50)]), rng.choice([None, "", " ".join(rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) for _ in range(120))])) for _ in range(150)]
    docs += [docs[2]] * 3 + [(k, " ".join(["chains"] * 2**k)) for k in range(3, 6)] + [(9, "chaims " * 3 + "chaimz " * 7 + "chaizz " * 20 + "chazzz " * 60)]
    docs += [(10, ("x" * 5000 + " ") * 9 + ("x" * 4999 + "!") * 3)]
    frame = spark.createDataFrame([(*d, "w", 5) for d in docs], "doc_id long, text string, word string, n long")
    expected = by_hand(docs)
    assert sorted(map(tuple, spelling.variants(frame).collect())) == expected
    assert any(r[1] != r[2] for r in expected if r[1])
    assert spelling.variants(frame.limit(0)).count() == 0


def test_every_pair_at_one_edit_shares_a_key():
    rng = random.Random(8)
    words = list({"".join(rng.choice("abcd") for _ in range(rng.randint(5, 12))) for _ in range(3000)})
    order = np.array(rng.sample(range(8100), 8100), np.int32)
    at, role, key = spelling.prefix_keys(words, order)
    left, right = {}, {}
    for w, r, k in zip(at.tolist(), role.tolist(), key.tolist(), strict=True):
        if r != spelling.LONGER:
            left.setdefault(words[w], set()).add(k)
        if r != spelling.SHORTER:
            right.setdefault(words[w], set()).add(k)
    known = set(words)
    for w in words:
        for i in range(len(w) + 1):
            for c in "abcd":
                for x in {w[:i] + c + w[i:], w[:i] + c + w[i + 1 :] if i < len(w) else w} & known - {w}:
                    assert left[w] & right[x], (w, x)


def executed(spark) -> dict[int, str]:
    """The plans of the session's executions so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}


def test_no_join_passes_a_table_through_the_driver(spark):
    docs = [(k, f"{'chazzz ' * 24} {'chaizz ' * 12} {'chaimz ' * 6} {'chaims ' * 3}") for k in range(3)]
    frame, before = spark.createDataFrame(docs, "doc_id long, text string"), executed(spark)
    assert sorted(map(tuple, spelling.variants(frame).collect())) == by_hand(docs)
    plans = [plan for key, plan in executed(spark).items() if key not in before]
    assert sum("SortMergeJoin" in plan for plan in plans) >= 4  # pairs, forms met, rounds of roots, the result
    assert not any("Broadcast" in plan for plan in plans)
