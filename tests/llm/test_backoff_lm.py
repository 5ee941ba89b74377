from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest

from pulsegrid.llm import backoff_lm
from pulsegrid.llm.common import held_out

MUS, DISCOUNT = (256.0, 8.0, 2.0), 0.75
BEGIN, END = "<b>", "<e>"


def tokens(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [END]


def trains(i) -> bool:
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


def brute(rows: list[tuple], order: int) -> list[tuple]:
    grams: list[Counter] = [Counter() for _ in range(order + 1)]
    for i, t in rows:
        if trains(i):
            w = [BEGIN] * (order - 1) + tokens(t)
            for n in range(1, order + 1):
                for k in range(order - 1, len(w)):
                    grams[n][tuple(w[k - n + 1 : k + 1])] += 1
            grams[0][()] += 1
    one = grams[1]
    total, types = sum(one.values()), len(one)

    def p(gram: tuple) -> float:
        if len(gram) == 1:
            if not total:
                return 1.0
            return (one[gram] - DISCOUNT) / total if one[gram] else DISCOUNT * types / total
        history = gram[:-1]
        held = grams[0][()] if set(history) == {BEGIN} else grams[len(history)][history]
        lower = p(gram[1:])
        mu = MUS[len(gram) - 2]
        return (grams[len(gram)][gram] + mu * lower) / (held + mu) if held else lower

    out = []
    for i, t in rows:
        w, own = [BEGIN] * (order - 1) + tokens(t), tokens(t)
        base = sum(math.log10((one[(x,)] + 0.5) / (total + 0.5 * (types + 1))) for x in own)
        score = sum(math.log10(p(tuple(w[k - order + 1 : k + 1]))) for k in range(order - 1, len(w)))
        out.append((i, len(own), sum(one[(x,)] > 0 for x in own), total, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


ROWS = [(i, " ".join(f"w{(i * 7 + k * k) % 13}" for k in range(i % 9)) + (" Ünseen%d" % i if i % 4 == 0 else "")) for i in range(60)]
ROWS += [(100, None), (101, ""), (102, "W1 w2\tW1\nw2"), (102, "W1 w2\tW1\nw2"), (None, "w1 w2 w3"), (103, "w1 " * 3000), (104, " ".join(f"w{k * k % 17}" for k in range(2000)))]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_a_dictionary_model(spark, order, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = backoff_lm.score(df, ["doc_id"], ~held_out("doc_id", 1), mus=MUS[: order - 1], shard_bits=2)
    rows = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got.collect()]
    for a, b in zip(sorted(rows, key=repr), brute(ROWS, order), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-4)


def test_weights_of_a_state_sum_to_one(spark):
    """Over all words of the training texts and one unseen word, read after the same history."""
    train = list(zip([i for i in range(100) if trains(i)], ["a b a c", "a b b", "c a b"], strict=False))
    asked = [i for i in range(1000, 1100) if not trains(i)][:5]
    probes = [(i, f"a {w}") for i, w in zip(asked, ["a", "b", "c", "never"], strict=False)] + [(asked[4], "a")]
    got = backoff_lm.score(spark.createDataFrame(train + probes, "doc_id long, text string"), ["doc_id"], ~held_out("doc_id", 1), mus=MUS[:1]).collect()
    scores = {r.doc_id: r.score for r in got}
    # "a x <end>" against "a <end>": take the end's weight after x out by scoring it alone
    counts = {"a": 4, "b": 4, "c": 2, END: 3}
    total = 13
    pairs = Counter()
    for _, t in train:
        w = [BEGIN, *tokens(t)]
        pairs.update(zip(w, w[1:], strict=False))
    uni = lambda w: (counts[w] - DISCOUNT) / total if w in counts else DISCOUNT * 4 / total
    bi = lambda h, w: (pairs[h, w] + MUS[0] * uni(w)) / (({BEGIN: 3} | counts).get(h, 0) + MUS[0])
    assert sum(bi("a", w) for w in ["a", "b", "c", END, "never"]) == pytest.approx(1)
    for i, w in zip(asked, ["a", "b", "c"], strict=False):
        assert scores[i] == pytest.approx(math.log10(bi(BEGIN, "a") * bi("a", w) * bi(w, END)), abs=1e-6)
    assert scores[asked[3]] == pytest.approx(math.log10(bi(BEGIN, "a") * bi("a", "never") * uni(END)), abs=1e-6)


def test_empty_table_and_no_training_text(spark):
    schema = "doc_id long, text string, block long, n int"
    assert backoff_lm.score(spark.createDataFrame([], schema), ["doc_id"], ~held_out("doc_id", 1)).count() == 0
    asked = next(i for i in range(1000) if not trains(i))
    r = backoff_lm.score(spark.createDataFrame([(asked, "a b", 1, 1)], schema), ["doc_id", "block"], ~held_out("doc_id", 1)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0) and r.base_score == pytest.approx(0.0)


def test_ngrams_that_differ_in_the_last_bits_alone_are_told_apart(monkeypatch):
    plain = backoff_lm.longer
    low = backoff_lm.np.uint64(0xFFFFF)
    monkeypatch.setattr(backoff_lm, "longer", lambda h, w: plain(h, w) & low)  # all in one shard, and equal but for twenty bits
    e = backoff_lm.Encoder()
    text = " ".join(f"w{k * k % 31}" for k in range(400))
    e.add(text.encode())
    block = backoff_lm.Block(*e.row(), [True], 2)
    w = [BEGIN, *tokens(text)]
    assert len(block.keys[1]) == len(set(zip(w, w[1:], strict=False)))
    assert sorted(block.counts(2)) == sorted(Counter(zip(w, w[1:], strict=False)).values())


def test_blocks_meet_their_answers_without_a_shuffle(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    blocks = backoff_lm.encode(df, ["doc_id"], ~held_out("doc_id", 1))
    answers = backoff_lm.train_and_ask(blocks, 2, 2)
    met = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: a.select(["block"]), "block long")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1 and plan.count("Exchange hashpartitioning(n") == 1, plan


@pytest.mark.parametrize("bits", [1, 8, 33, 57, 64])
def test_packed_keys_come_back(bits):
    rng = backoff_lm.np.random.default_rng(bits)
    for n in (0, 1, 2, 300, 9000):
        keys = backoff_lm.np.unique(rng.integers(0, 1 << bits, n, dtype=backoff_lm.np.uint64, endpoint=bits < 64) if bits < 64 else rng.integers(0, 1 << 63, n, dtype=backoff_lm.np.uint64) * backoff_lm.np.uint64(2))
        assert (backoff_lm.unpacked(backoff_lm.packed(keys)) == keys).all()


def test_clashing_names(spark):
    rows = [(i, f"a b c{i % 3}", "k", 1, [True]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, n int, trained array<boolean>")
    plain = backoff_lm.score(df.select("doc_id", "text"), ["doc_id"], ~held_out("doc_id", 1)).collect()
    clashing = backoff_lm.score(df, ["doc_id", "block", "trained"], ~held_out("doc_id", 1)).collect()
    assert sorted((r.doc_id, r.score) for r in plain) == sorted((r.doc_id, r.score) for r in clashing)
    assert {(r.block, tuple(r.trained)) for r in clashing} == {("k", (True,))}
