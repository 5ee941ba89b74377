from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import simhash_bktree as sh


def brute_fingerprint(text: str | None, shingle: int) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: dict[int, int], radius: int) -> dict[int, int]:
    ids, root = sorted(fps), {i: i for i in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def texts(seed: int = 5) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "one two"), (6, "a b c")]
    for k in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        for c in range(4):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((10 + 4 * k + c, " ".join(copy)))
    return rows


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = texts()
    got = sh.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = {i: brute_fingerprint(t, 3) for i, t in rows}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps, 3)
    assert any(r.component_id != r.doc_id for r in got)


@pytest.mark.parametrize("most", [40, 4096])
def test_links_survive_dealing_shards_again(spark, monkeypatch, most):
    monkeypatch.setattr(sh, "SHARD", most)
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(25)]
    fps += [rng.getrandbits(64) for _ in range(60)]
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "id long, fp long")
    roots = {r.node: r.root for r in sh.connected_components(sh.links(df.select("fp"), 3)).collect()}
    expected = brute_components(dict(enumerate(fps)), 3)
    groups: dict[int, set] = {}
    for (i, f) in rows:
        groups.setdefault(expected[i], set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_tree_search_finds_what_comparing_all_finds():
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 1 << 20, 400).astype(np.uint64))
    forest = sh.Forest(fp, np.zeros(len(fp), np.int64))
    for radius in (0, 3, 7):
        found = {(int(a), int(b)) for q, node in forest.search(fp, np.zeros(len(fp), np.int64), radius) for a, b in zip(q, node, strict=True)}
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
        assert found == set(zip(*map(list, np.nonzero(near)), strict=True))


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "x y z"), (5, "x y z"), (None, "x y z"), (None, "q r s t")]
    got = sorted(((r.doc_id, r.component_id) for r in sh.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (None, None)], key=repr)
    assert sh.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text_and_clashing_names(spark):
    long = " ".join(f"w{k * k % 9973}" for k in range(400_000))
    rows = [(1, long, 5, "a"), (2, long + " x", 5, "b"), (3, "another text of its own", 5, "c")]
    got = sh.components(spark.createDataFrame(rows, "doc_id long, text string, fp long, node string"), shingle=3, radius=3).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3)]
