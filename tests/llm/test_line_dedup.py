from __future__ import annotations

import numpy as np
import pytest

from pulsegrid.llm import line_dedup
from pulsegrid.llm.line_dedup import CuckooFilter, LineIndex, drop_frequent_lines, words

SPACE = " \t\n\x0b\x0c\r"


def key_of(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows: list[tuple], least: int) -> list[tuple]:
    texts = [(i, (t or "").split("\n")) for i, t in rows]
    docs: dict[str, int] = {}
    for _, lines in texts:
        for k in {key_of(x) for x in lines} - {""}:
            docs[k] = docs.get(k, 0) + 1
    out = []
    for i, lines in texts:
        kept = [x for x in lines if docs.get(key_of(x), 0) < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


ROWS = [
    (1, "Common\nown one\n common \r\nCOMMON"),
    (2, "common\n\n\nother"),
    (3, "\tCommon\x0b\nÄrger"),
    (4, None),
    (5, ""),
    (6, "ärger\nÄrger\ncommon"),
    (7, "Ärger"),
    (7, "Ärger"),
    (None, "common"),
    (9, "long " * 20_000 + "\nown"),
]


def found(spark, rows, least, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = LineIndex.build(df, least, **more)
    return sorted((tuple(r) for r in drop_frequent_lines(df, index, ["doc_id"]).collect()), key=repr)


@pytest.mark.parametrize("least", [2, 3, 4, 6])
def test_equals_brute_force(spark, least):
    assert found(spark, ROWS, least) == brute(ROWS, least)


def test_a_single_shard_and_an_empty_table(spark):
    assert found(spark, ROWS, 3, shards=1) == brute(ROWS, 3)
    assert found(spark, [], 3) == []


def test_further_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "a\nb", "x", 2), (2, "a", "y", 3)], "doc_id long, text string, key string, n int")
    rows = drop_frequent_lines(df, LineIndex.build(df, 2), ["doc_id", "key", "n"]).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, "x", 2, "b", 2, 1), (2, "y", 3, "", 1, 1)]


def test_deleting_what_was_inserted_gives_the_former_state_back(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string")
    more = spark.createDataFrame([(10 + i, "other\nown one\nnew") for i in range(3)], "doc_id long, text string")
    first = LineIndex.build(base, 3)
    grown = first.insert(more)
    back = grown.delete(more)
    refs = lambda index: {bytes(r.key): r.n for r in index.refs.collect()}
    assert refs(back) == refs(first)
    assert refs(grown) == refs(LineIndex.build(base.union(more), 3))
    both = base.union(more)
    as_rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert as_rows(drop_frequent_lines(both, grown, ["doc_id"])) == brute(ROWS + [(10 + i, "other\nown one\nnew") for i in range(3)], 3)
    assert as_rows(drop_frequent_lines(base, back, ["doc_id"])) == brute(ROWS, 3)


def test_of_each_frequent_line_one_text_keeps_its_own(spark):
    df = spark.createDataFrame([(1, "x\na"), (2, "x\nb"), (3, "x\nc")], "doc_id long, text string")
    kept = drop_frequent_lines(df, LineIndex.build(df, 3), ["doc_id"], keep_first=True).collect()
    assert sum("x" in r.kept_text for r in kept) == 1 and all(r.kept_text[-1] in "abc" for r in kept)


def test_cuckoo_filter_holds_all_keys_and_forgets_deleted_ones():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (3000, 2)).astype(np.uint64)
    f = CuckooFilter(100)  # far too small, so the overflow set is used
    f.insert(keys)
    assert f.overflow and f.contains(keys).all()
    again = CuckooFilter.from_bytes(f.to_bytes())
    assert again.contains(keys).all()
    again.delete(keys[:1500])
    assert again.contains(keys[1500:]).all()
    roomy = CuckooFilter(6000)
    roomy.insert(keys)
    other = rng.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    assert not roomy.overflow and roomy.contains(other).mean() < 0.01
    roomy.delete(keys)
    assert not roomy.table.any()


def test_digests_are_two_words():
    assert words([line_dedup.digest(b"a"), line_dedup.digest(b"b")]).shape == (2, 2)


@pytest.mark.parametrize("hot", [2, 1000])
def test_texts_that_many_rows_hold(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rows = [(i, "one\ntwo\nthree") for i in range(300)] + [(300 + i, f"own {i}\ntwo") for i in range(100)] + [(400, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((tuple(r) for r in drop_frequent_lines(df, LineIndex.build(df, 10), ["doc_id"]).collect()), key=repr)
    assert got == brute(rows, 10)
    kept = {r.doc_id: r.kept_text for r in drop_frequent_lines(df, LineIndex.build(df, 10), ["doc_id"], keep_first=True).collect()}
    assert len(kept) == 401 and sum("two" in t for t in kept.values()) in (1, 300)


def test_a_full_filter_grows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    index = LineIndex.build(df, 2, shards=1)
    small = CuckooFilter.from_bytes(bytes(index.filters.first()["filter"])).capacity
    lines = "\n".join(f"line {i}" for i in range(20 * small))
    grown = index.insert(spark.createDataFrame([(3, lines), (4, lines)], "doc_id long, text string"))
    held = CuckooFilter.from_bytes(bytes(grown.filters.first()["filter"]))
    assert held.capacity > 20 * small and not held.overflow
    assert [r.n_dropped for r in drop_frequent_lines(df, grown, ["doc_id"]).collect()] == [1, 1]
