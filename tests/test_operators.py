"""Operators by hand-made rows."""

from __future__ import annotations

import pytest

from pulsegrid.operators import breakdowns, queue

PASSING = [
    "classifier_error: x", "quota_deferred", "code RESOURCE_EXHAUSTED", "unavailable", "TypeError: Fetch failed", "Request Timeout", "connect ETIMEDOUT 1.2.3.4", "read ECONNRESET", "http 429", "http 500",
    "http 502", "http 503", "http 504", "Expected ',' after array", "Unexpected end of JSON input", "at position 7", "unparseable_response", "result_count_mismatch", "missing_result_index",
]
LASTING = [None, "", "missing_relevant_boolean", "missing_results_array", "missing_or_invalid_sentiment", "result_not_object", "aborted", "rate limit", "529", "overloaded", "quota exceeded"]


def test_failed_posts_with_passing_errors_are_reset(spark):
    rows = [(i, "failed", e) for i, e in enumerate(PASSING + LASTING)] + [(100, "retry", "timeout")]
    got = queue.reset_failed(spark.createDataFrame(rows, "id long, status string, error string")).collect()
    assert sorted(r.id for r in got) == list(range(len(PASSING)))
    assert {(r.status, r.attempts, r.next_at, r.error) for r in got} == {("pending", 0, None, None)}


def test_usage_gathers_no_group(spark):
    groups = {"a": [1.0], "b": [5.0, 1.0, 3.0, 3.0], None: [float(i % 37) for i in range(100)], "d": [None, None], "e": [None, 2.0]}
    rows = [(k, x, 0.0) for k, v in groups.items() for x in v]
    df = breakdowns.usage(spark.createDataFrame(rows, "tier string, tokens double, cached double"), "tier", "tokens", 0.001, "cached")
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "collect_list" not in plan and "percentile" not in plan
    got = {r.tier: r for r in df.collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        x = sorted(a for a in v if a is not None)
        assert got[k].n == len(v) and got[k].total == (sum(x) if x else None)
        assert got[k].median == (pytest.approx((x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2) if x else None)
        assert got[k].p95 == (x[min(int(len(x) * 0.95), len(x) - 1)] if x else None)
