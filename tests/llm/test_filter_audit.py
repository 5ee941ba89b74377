from __future__ import annotations

import random
import re
from itertools import permutations

from pulsegrid.llm import filter_audit
from pulsegrid.llm.queries import ORACLE, QUERIES
from tests.conftest import DATA, rows_of, rows_of_sql


def by_hand(docs: list[tuple], labels: dict) -> list[tuple]:
    """Every document through every order of the filters, one by one."""
    fails, parts = [], {}
    for i, (doc_id, text, lang) in enumerate(docs):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == t for o in docs)
        fails.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy})
        parts.setdefault(lang or "", []).append(i)
    rows = []
    for part, ids in parts.items():
        shares, here = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = ids
            for step, f in enumerate(order, 1):
                gone = [i for i in left if fails[i][f]]
                left = [i for i in left if not fails[i][f]]
                shares[f] += len(gone)
                lost = [sum(labels.get(docs[i][0], (0, 0))[k] for i in gone) for k in (0, 1)]
                here.append((part, "".join(order), step, len(left), len(gone), sum(fails[i][f] for i in ids) - len(gone), sum(fails[i][f] and sum(fails[i].values()) == 1 for i in ids), *lost, f))
        rows += [(*r[:-1], shares[r[-1]]) for r in here]
    return sorted(rows)


def test_query_equals_its_sql(spark, duck):
    assert rows_of(QUERIES["op12_filter_audit"](spark, f"{DATA}/sf0.001")) == rows_of_sql(duck, ORACLE["op12_filter_audit"])


def test_against_every_order_by_hand(spark):
    rng = random.Random(5)
    texts = [None, "", "a b", "A B C", "x#y", *(" ".join(rng.choice(["one", "Two", "3%", "four", f"w{rng.randint(0, 400)}"]) for _ in range(rng.choice([150, 200, 260]))) for _ in range(25))]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(150)]
    docs += [docs[0]] * 3 + [(7, texts[6], "en")] * 2 + [(70 + k, texts[7], "de") for k in range(40)]
    labels = {i: (rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 100, 2)}
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, mask string, n long")
    marks = spark.createDataFrame([(None, 1, 1), *((i, *v) for i, v in labels.items()), (4, None, 0), (6, labels[6][0], labels[6][1])], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filter_audit.audit(frame, marks).collect())) == by_hand(docs, labels)


def test_empty_tables_and_a_very_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, marks).count() == 0
    long = spark.createDataFrame([(1, "word other " * 500_000, "en")], none.schema)
    assert [r.mask for r in filter_audit.mask_counts(long, marks).where("n > 0").collect()] == [2]


def test_shapley_shares_add_up():
    counts = {m: m * m % 7 for m in range(32)}
    p = filter_audit.removal_polynomial(counts)
    assert sum(filter_audit.shapley(p, i) for i in range(5)) == filter_audit.at_corner(p, frozenset(range(5))) == sum(n for m, n in counts.items() if m)
