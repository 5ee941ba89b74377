"""Bounded calls, staged samples, prices, lineups, clocks and claims in texts, by hand-made rows."""

from __future__ import annotations

import random
import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scope, text
from pulsegrid.operators import breakdowns, calls, canon, leaderboard, monitor, prices, rumors, sampling, scoring


def test_results_lie_in_their_places():
    said = lambda i: {"index": i, "x": i}
    assert calls.placed([said(1), said(0)], 2) == ([said(0), said(1)], None)
    assert calls.placed([said(1)], 2) == ([None, said(1)], calls.MISSING)
    assert calls.placed([said(0), {"index": 0, "x": 9}, said(7)], 2) == ([said(0), None], calls.MISSING)
    assert calls.placed([{"x": 1}], 2) == ([None, None], calls.MISCOUNTED)
    assert calls.placed([{"x": 1}, {"x": 2}], 2) == ([{"x": 1}, {"x": 2}], None)
    assert calls.placed([], 0) == ([], None)


def test_failed_slices_are_tried_again_and_then_one_by_one():
    seen = []

    def call(texts):
        seen.append(list(texts))
        if "bad" in texts:
            raise TimeoutError("504")
        return [{"t": t} for t in texts]

    found = calls.called(call, ["a", "bad", "b"], 3)
    assert [r for r, _ in found] == [{"t": "a"}, None, {"t": "b"}]
    assert found[1][1] == "classifier_error: 504"
    assert seen == [["a", "bad", "b"]] * 3 + [["a"]] + [["bad"]] * 3 + [["b"]]
    once = iter([ValueError(), None])

    def second(texts):
        if e := next(once, None):
            raise e
        return [{"t": t} for t in texts]

    assert [e for _, e in calls.called(second, ["a", "b"], 3)] == [None, None]


def test_every_post_gets_a_result_or_an_error_from_bounded_slices(spark):
    def call(texts):
        if len(texts) > 20:
            raise AssertionError("slice too long")
        time.sleep(0.001)
        name = threading.current_thread().name
        if any("boom" in t for t in texts):
            raise ValueError("no")
        return [{"index": i, "t": t, "thread": name} for i, t in reversed(list(enumerate(texts)))]

    rows = spark.createDataFrame([(i, None if i % 50 == 0 else "boom" if i % 97 == 0 else f"t{i}") for i in range(500)], "id long, title string").coalesce(1)
    got = {r.id: r for r in calls.classify(rows, call, lanes=3).select("id", "error", F.get_json_object("said", "$.t").alias("t"), F.get_json_object("said", "$.thread").alias("thread")).collect()}
    assert len(got) == 500
    for i, r in got.items():
        if i % 50 and i % 97 == 0:
            assert (r.t, r.error) == (None, "classifier_error: no")
        else:
            assert (r.t, r.error) == ("" if i % 50 == 0 else f"t{i}", None)
    assert 1 <= len({r.thread for r in got.values() if r.thread}) <= 3
    assert calls.classify(rows.limit(0), call).count() == 0


def test_staged_sample_against_a_loop(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "c", "c", "c", None]), rng.random() < 0.2, rng.choice([None, True, False]), rng.random() < 0.5) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, g string, f1 boolean, f2 boolean, stage boolean")
    frame = frame.withColumnRenamed("stage", "f3")
    stages = [("one", F.col("f1"), 3), ("two", F.col("f2"), 5), ("three", F.col("f3"), 0), ("rest", F.lit(True), 100)]
    expected = {}
    for g in {r[1] for r in rows}:
        taken = 0
        for k, (name, _, quota) in enumerate(stages):
            left = quota
            for r in rows:
                if r[1] == g and r[0] not in expected and taken < 11 and left > 0 and (k == 3 or r[2 + k]):
                    expected[r[0]] = name
                    taken, left = taken + 1, left - 1
    assert {r.id: r.stage for r in sampling.staged(frame, "g", stages, 11, "id").collect()} == expected


def test_costs_by_the_price_of_the_time(spark):
    t = lambda d, h=0: datetime(2026, 1, d, h)
    usage = [("m", t(1, 5), 1e6, 0.0, 0.0), ("m", t(2, 11), 1e6, 1e6, 1e6), ("m", t(2, 12), 1e6, 0.0, 0.0), ("m", t(9), 1.0, 1.0, None), ("x", t(2), 1.0, 1.0, 0.0), (None, t(2), 1.0, None, 0.0)]
    held = [("m", t(2), t(2, 12), 10.0, 50.0), ("m", t(2, 12), t(4), 20.0, 1.0), ("m", t(8), None, 1.0, 1.0), ("m", t(5), t(5), 9.0, 9.0)]
    u = spark.createDataFrame(usage, "model string, at timestamp, input double, output double, cached double")
    p = spark.createDataFrame(held, "model string, since timestamp, until timestamp, input_price double, output_price double")
    got = {(r.model, r["at"]): r.cost for r in prices.priced(u, p).collect()}
    assert got[("m", t(1, 5))] is None and got[("x", t(2))] is None and got[(None, t(2))] is None
    assert got[("m", t(2, 11))] == pytest.approx(51.0) and got[("m", t(2, 12))] == pytest.approx(20.0) and got[("m", t(9))] == pytest.approx(2e-6)
    day = {(r.model, str(r.day)): r for r in prices.by_day(u, p).collect()}[("m", "2026-01-02")]
    assert (day.calls, day.unpriced, day.cost, day.cost_per_1k) == (2, 0, 71.0, 35500.0)
    assert prices.priced(u.limit(0), p).count() == 0 and prices.priced(u, p.limit(0)).where("cost is not null").count() == 0


def test_declared_successors_chains_and_circles(spark):
    rows = [
        ("old", "Alpha 1", True, False, None), ("new", "Alpha 2", True, False, None), ("renamed", "Beta", True, False, None), ("alpha2x", "Alpha 3", True, False, "renamed"), ("base", "Alpha 9", True, True, None),
        ("c1", None, True, False, "c2"), ("c2", "", True, False, "c3"), ("c3", None, None, False, "c1"), ("into", None, False, False, "c1"), ("self", None, True, False, "self"), ("gone", None, True, False, "nowhere"), ("unranked", "Alpha 0.5", False, False, "base"),
    ]
    got = {r.name: (r.successor, r.final) for r in leaderboard.lineup(spark.createDataFrame(rows, "name string, label string, ranked boolean, is_baseline boolean, superseded_by string")).collect()}
    assert got == {
        "old": ("alpha2x", "renamed"), "new": ("alpha2x", "renamed"), "renamed": (None, None), "alpha2x": ("renamed", "renamed"), "base": (None, None), "c1": ("c2", None), "c2": ("c3", None), "c3": ("c1", None),
        "into": ("c1", None), "self": (None, None), "gone": (None, None), "unranked": ("alpha2x", "renamed"),
    }


def test_wall_times_in_the_missing_and_the_doubled_hour(spark):
    cases = {("2024-03-10", "00:00"): "2024-03-10 08:00", ("2024-03-10", "02:30"): "2024-03-10 09:30", ("2024-03-10", "03:30"): "2024-03-10 10:30", ("2024-11-03", "01:30"): "2024-11-03 08:30", ("2024-11-03", "02:30"): "2024-11-03 10:30", ("2024-07-01", "12:00"): "2024-07-01 19:00"}
    rows = spark.createDataFrame([*cases, ("no date", "00:00"), (None, "00:00")], "label string, time string")
    got = {(r.label, r.time): r.t and r.t.strftime("%Y-%m-%d %H:%M") for r in scoring.with_instant(rows, "label", "time", scoring.ZONE, "t").collect()}
    assert got == cases | {("no date", "00:00"): None, (None, "00:00"): None}
    days = spark.createDataFrame([(datetime(2024, 3, 10, 12),), (datetime(2024, 11, 3, 12),), (datetime(2026, 4, 18, 15, 42, 10),)], "at timestamp")
    found = sorted((r.label, (r.range_end - r.range_start).total_seconds() / 3600, r.range_start.hour) for r in scoring.day_window(days, "at").collect())
    assert found == [("2024-03-10", 23.0, 8), ("2024-11-03", 25.0, 7), ("2026-04-18", 24.0, 7)]


def test_claims_in_the_window_of_the_version(spark):
    far = "x" * 400
    rows = [
        (1, f"mid-July is hot. Gemini 3.5 Pro is delayed to next week. this week {far}"), (2, f"{far} 3.5 pro {far} delayed"), (3, f"in july. {far}; 3,5 Pro leaked; {far}"), (4, "spotted something else"), (5, None), (6, "GEMINI  3.5 PRO in testing"), (7, ""), (8, "Gemini 3.5 Pro"),
    ]
    got = {r.id: (r.version_label, r.claim_type, r.eta_text, r.claim_summary) for r in scope.recovered_claims(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {
        1: ("Gemini 3.5 Pro", "delayed", "next week", "Gemini 3.5 Pro is delayed to next week."), 3: ("3.5 Pro", "launch", "July", "Gemini 3.5 Pro is being discussed as an upcoming release."),
        6: ("Gemini 3.5 Pro", "in_testing", None, "Gemini 3.5 Pro is being discussed as in testing."),
    }


def test_quotes_collapse_by_the_id_of_the_post(spark):
    rows = [("f", "k", "https://x.com/a/status/100", None), ("f", "k", "https://x.com/b/status/200", "100"), ("f", "k", "https://reddit.com/r/s/1", "100"), ("f", "k", "https://x.com/c/status/300", "999"), ("f", "other", "https://x.com/d/status/400", "100"), ("f", "k", None, None)]
    kept = rumors.without_echoes(spark.createDataFrame(rows, "family string, cluster_key string, url string, quoted string"))
    assert sorted(str(r.url) for r in kept.collect()) == ["None", "https://x.com/a/status/100", "https://x.com/c/status/300", "https://x.com/d/status/400"]
    urls = spark.createDataFrame([("https://x.com/s/status/12345", "12345"), ("https://bsky.app/profile/e.com/post/3abc", "3abc"), ("https://reddit.com/r/x/comments/abc", None), (None, None)], "url string, id string")
    assert urls.where(~canon.status_id(F.col("url")).eqNullSafe(F.col("id"))).count() == 0
    said = spark.createDataFrame([("mirror of https://x.com/s/status/12345", None, "12345"), ("self https://x.com/s/status/12345", "https://x.com/me/status/12345", None), ("nothing", None, None), (None, None, None)], "body string, url string, id string")
    assert said.where(~canon.quoted_in_text(F.col("body"), F.col("url")).eqNullSafe(F.col("id"))).count() == 0


def test_claims_without_a_name_are_no_product(spark):
    rows = [(1, "f", "A-1", None), (2, "f", "a1", "red"), (3, "f", None, "red"), (4, "f", None, None), (5, "f", "--", "??"), (6, "f", "", "red"), (7, "g", None, "red")]
    got = {r.id: r.cluster_key for r in rumors.clusters(spark.createDataFrame(rows, "id long, family string, label string, codename string")).collect()}
    assert got == {1: "a1", 2: "a1", 3: "a1", 6: "a1", 7: "red"}
    both = spark.createDataFrame([(1, "f", "Opus five", "red"), (2, "f", "Opus", None), (3, "f", "opus", "red"), (4, "f", "Opus5", None), (5, "f", "opus 5", None)], "id long, family string, label string, codename string")
    assert {r.id: r.cluster_key for r in rumors.clusters(both).collect()} == {1: "opus", 2: "opus", 3: "opus", 4: "Opus5", 5: "Opus5"}


def test_alerts_by_source_with_partial_runs_and_no_runs(spark):
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    t = lambda h: datetime(2026, 1, 7 + h // 24, h % 24)
    runs = [("a", "success", t(70)), ("b", "partial", t(60)), ("c", "failed", t(71)), ("c", "success", t(41)), ("d", "failed", t(71)), ("d", "partial", t(50)), ("e", "failed", t(71))]
    limits = spark.createDataFrame([("a", 11), ("b", 11), ("c", 11), ("d", 27), ("e", 27), ("never", 5)], "source string, hours int")
    health = spark.createDataFrame([(300, 200, 0, 19, t(71))], "queued long, retrying long, failed long, recent_failed long, oldest_queued_at timestamp")
    computed = spark.createDataFrame([(None,)], "score_computed_at timestamp")
    frame = spark.createDataFrame(runs, "source string, status string, started_at timestamp")
    got = {(r.alert, r.subject): r.amount for r in monitor.alerts(health, frame, limits, computed, now, now).collect()}
    assert got == {("queue_backlog", ""): 500, ("queue_age", ""): 60, ("aggregation_lag", ""): None, ("source_stale", "b"): 12, ("source_no_success", "c"): 31, ("source_no_success", "e"): None, ("source_stale", "never"): None}


def test_posts_without_url_are_told_by_source_and_text(spark):
    rows = [("u", "a", None, None, "t"), ("", "a", None, "body", "t"), (None, "a", "", "body", "x"), (None, "b", "translated", "body", "x"), (None, None, None, None, None)]
    keys = spark.createDataFrame(rows, "url string, source string, tr string, body string, title string").select(breakdowns.post_key(*map(F.col, ("url", "source", "tr", "body", "title"))).alias("k"))
    assert [r.k for r in keys.collect()] == ["u", "a::body", "a::body", "b::translated", "::"]


def test_repeated_ids_multiply_nothing_in_agreement(spark):
    a = spark.createDataFrame([(1, "positive"), (1, "positive"), (2, "negative")], "id long, sentiment string")
    b = spark.createDataFrame([(1, "positive"), (1, "positive"), (1, "positive"), (2, "neutral")], "id long, sentiment string")
    r = breakdowns.agreement(a, b, "id", ["sentiment"]).collect()[0]
    assert (r.n, r.sentiment_rate) == (2, 0.5)


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        (("@AnthropicAI", "https://x.com/anthropicai/status/1", "twitter", False), "official"), (("apples_jimmy", None, "twitter", False), "tracked_leaker"), ((None, "https://www.polymarket.com/e/1", "web", False), "prediction_market"),
        (("someone", "https://www.theverge.com/1", "web", False), "press_echo"), (("someone", None, "bluesky", True), "press_echo"), ((None, None, "github", False), "artifact_leak"), (("axios", None, "twitter", True), "press_scoop"), ((None, "https://notopenai.com/", "web", False), "unknown"), ((None, None, None, False), "unknown"),
    ],
)
def test_source_quality(spark, row, expected):
    df = spark.createDataFrame([row], "handle string, url string, platform string, quotes boolean")
    assert df.select(text.source_quality(*map(F.col, df.columns))).first()[0] == expected


def test_times_in_words(spark):
    said = [("Q3 2026", "2026-07-01"), ("early May 2026", "2026-05-01"), ("mid-june", "2026-06-11"), ("late February", "2027-02-21"), ("next week", "2026-05-18"), ("this month", "2026-05-01"), ("next month", "2026-06-01"), ("on 2026-08-15 maybe", "2026-08-15"), ("someday", None)]
    seen = F.lit("2026-05-14 10:00:00").cast("timestamp")
    got = spark.createDataFrame(said, "said string, eta string").select("eta", rumors.eta(F.col("said"), seen).cast("string").alias("found")).collect()
    assert all(r.eta == r.found for r in got)
