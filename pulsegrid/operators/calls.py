"""Calls of a classifier that is slow, costs money and sometimes fails: bounded slices, lanes, attempts, and results in their places."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import queue

#: Errors of results, all worth another attempt later.
FAILED, MISCOUNTED, MISSING = "classifier_error", "result_count_mismatch", "missing_result_index"


def placed(results: list[dict], n: int) -> tuple[list[dict | None], str | None]:
    """Results of a call in the places of its n texts: by their ``index`` (from 0) if they carry one, else by order, which needs the right number.

    Of two results with one index the first counts; an index beyond the texts counts for none. The error says why places may be empty.
    """
    if results and all(isinstance(r, dict) and isinstance(r.get("index"), int) for r in results):
        out: list[dict | None] = [None] * n
        for r in results:
            if 0 <= r["index"] < n and out[r["index"]] is None:
                out[r["index"]] = r
        return out, None if all(r is not None for r in out) else MISSING
    if len(results) != n:
        return [None] * n, MISCOUNTED
    return [r if isinstance(r, dict) else None for r in results], None if all(isinstance(r, dict) for r in results) else MISSING


def called(call: Callable[[list[str]], list[dict]], texts: list[str], attempts: int) -> list[tuple[dict | None, str | None]]:
    """(result, error) of each text of a slice: the slice is tried up to ``attempts`` times, then each text that has none alone."""

    def tried(part: list[str], times: int) -> tuple[list[dict | None], str | None]:
        error = FAILED
        for _ in range(times):
            try:
                found, error = placed(call(part), len(part))
            except Exception as e:  # whatever a call may raise, its posts are to be tried again later
                error = f"{FAILED}: {e}"[:200]
                continue
            if error is None or any(r is not None for r in found):
                return found, error
        return [None] * len(part), error

    found, error = tried(texts, attempts)
    out = []
    for text, r in zip(texts, found, strict=True):
        why = None if r is not None else error
        if r is None and len(texts) > 1:
            (r,), why = tried([text], attempts)
        out.append((r, None if r is not None else why or MISSING))
    return out


def classify(posts: DataFrame, call: Callable[[list[str]], list[dict]], text: str = "title", slice_size: int = 20, lanes: int = 4, attempts: int = 3) -> DataFrame:
    """(id, said, error) for every post: the classifier's answer as JSON or why there is none.

    A worker sends slices of at most ``slice_size`` texts, ``lanes`` of them at a time, and holds one Arrow batch; null texts are sent as empty ones. A
    task that is repeated calls again, so answers that must not be paid for twice are written out before they are used.
    """
    kind = posts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(lanes) as pool:
            for batch in batches:
                texts = [t if isinstance(t, str) else "" for t in batch[text]]
                slices = [texts[k : k + slice_size] for k in range(0, len(texts), slice_size)]
                found = [x for part in pool.map(lambda s: called(call, s, attempts), slices) for x in part]
                said = [None if r is None else json.dumps({k: v for k, v in r.items() if k != "index"}) for r, _ in found]
                yield pd.DataFrame({"id": batch["id"].to_numpy(), "said": pd.Series(said, dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    return posts.select("id", text).mapInPandas(run, f"id {kind}, said string, error string")


def written_back(posts: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Posts (id, status, attempts, next_at, classified_at, error, sentiment, confidence) after results (id, result_status, relevant, result_sentiment, result_confidence,
    result_error, retry_after_ms); posts without a result stay as they are."""
    names = ("status", "attempts", "next_at", "classified_at", "error", "sentiment", "confidence")
    done = queue.transition(posts.select("id", "attempts").join(results, "id"), now)
    changed = done.select("id", *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_hit"))
    rows = posts.join(changed, "id", "left")
    return rows.select("id", *(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names))
