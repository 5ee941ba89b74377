"""Words that tell something only together."""

from __future__ import annotations

import numpy as np

from pulsegrid.llm import toxicity_fm


def made(n: int, seed: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Texts toxic where both words stand, or neither but an insult; either word by itself has the mean share of toxic texts."""
    rng = np.random.default_rng(seed)
    kind = rng.choice(5, n, p=[0.15, 0.15, 0.3, 0.3, 0.1])
    words = [["plain"], ["insulted"], ["groups"], ["wanted"], ["groups", "wanted"]]
    texts = [" ".join([f"w{i}" for i in rng.integers(0, 400, 40)] + words[k]) for k in kind]
    return [toxicity_fm.terms(t.encode()).astype(np.int64) for t in texts], np.isin(kind, (1, 4)).astype(float), kind


def test_two_harmless_words_are_toxic_together():
    texts, target, _ = made(4000, 1)
    held = np.bincount(np.concatenate(texts), minlength=toxicity_fm.BUCKETS)
    pair = toxicity_fm.terms(b"groups wanted")
    assert not np.isin(pair, toxicity_fm.telling(texts, target, held)).any()
    model = toxicity_fm.Machine.fit(texts, target)
    texts, target, kind = made(1000, 2)
    score = model.score(texts)
    assert score[kind == 4].min() > 0.5 and score[(kind == 2) | (kind == 3)].max() < 0.5
    assert ((score > 0.5) == (target > 0)).mean() > 0.95
    assert len(model.ids) < 20
