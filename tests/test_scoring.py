"""Scores by hand-made expectations."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import scoring, series
from pulsegrid.plans import catalogue, scores
from tests.conftest import DATA

SCHEMA = "model_id string, source string, posted_at timestamp, sentiment string, status string, confidence double, engagement int, content_type string, complaint string"


def post(sentiment, source="bluesky", confidence=1.0, engagement=1, status="classified", day=1):
    return ("m", source, datetime.datetime(2024, 1, day, 20), sentiment, status, confidence, engagement, "title_and_body", None)


def raw(spark, posts):
    r = scoring.raw_scores(spark.createDataFrame(posts, SCHEMA), scoring.day_start(F.col("posted_at"))).first()
    return None if r is None else r.raw_score


@pytest.mark.parametrize(
    ("posts", "score"),
    [
        ([post("positive")] * 9 + [post("negative", "twitter")], 83),  # the cap is loose while the rest is light
        ([post("positive")] * 9 + [post("negative", "twitter")] * 3, 50),
        ([post("positive")] * 3, 100),
        ([post("neutral")] * 2, 50),
        ([post(None, confidence=0.95), post("negative")], 0),
        ([post("positive", confidence=None)], None),  # unknown confidence never scores
    ],
)
def test_raw_score(spark, posts, score):
    assert raw(spark, posts) == score


def test_reach_is_capped(spark):
    assert raw(spark, [post("positive", engagement=1000), post("negative", "twitter")]) == raw(spark, [post("positive", engagement=10**6), post("negative", "twitter")])


@pytest.mark.parametrize(("n", "score"), [(4, 70), (5, 73), (9, 83), (10, 85)])
def test_smoothing_ramp(spark, n, score):
    w = scoring.smoothing_weight(F.lit(n))
    assert spark.range(1).select(scoring.half_up(w * 100 + (1 - w) * 50)).first()[0] == score


def test_a_thin_day_moves_the_score_little_and_empty_days_are_skipped(spark):
    rows = [post("negative", day=1)] * 12 + [post("positive", day=4)]
    got = [(r.period_start.day, r.score) for r in scoring.daily(spark.createDataFrame(rows, SCHEMA)).orderBy("period_start").collect()]
    assert got == [(1, 0), (4, 20)]


def test_queued_posts_lower_coverage(spark):
    r = scoring.daily(spark.createDataFrame([post("positive"), post(None, status="pending")], SCHEMA)).first()
    assert (r.total_posts, r.eligible_posts, r.queued_posts, r.unclassified_posts) == (2, 1, 1, 1)
    assert r.classification_coverage == 0.5 and r.score_basis_status == "partial_coverage"


def test_pacific_days_begin_with_the_zone(spark):
    times = ["2026-04-18 15:42:10", "2026-03-09 06:59:59", "2026-11-02 07:30:00"]
    got = [str(spark.sql(f"select timestamp '{t}' as t").select(scoring.day_start(F.col("t"))).first()[0]) for t in times]
    assert got == ["2026-04-18 07:00:00", "2026-03-08 08:00:00", "2026-11-01 07:00:00"]


def test_no_posts_give_no_scores(spark):
    assert scoring.daily(spark.createDataFrame([], SCHEMA)).count() == 0


def test_history_begins_with_the_first_scored_day(spark):
    wanted = scores.daily(spark, f"{DATA}/sf0.01").where("model_id = 'm1' AND period_start <= TIMESTAMP '2024-01-25'").select("period_start").collect()
    found = [r.period_start for r in catalogue.QUERIES["score_history"](spark, f"{DATA}/sf0.01").collect()]
    assert found == sorted((r.period_start for r in wanted), reverse=True)
    assert found[-1] < datetime.datetime(2024, 1, 5)


def test_both_ends_of_a_range_are_included_and_may_be_open(spark):
    rows = spark.createDataFrame([(datetime.datetime(2024, 1, d),) for d in range(1, 6)], "at timestamp")
    days = lambda *ends: sorted(r.at.day for r in series.between(rows, "at", *ends).collect())
    assert (days("2024-01-02", "2024-01-04"), days("2024-01-04"), days(None, "2024-01-02")) == ([2, 3, 4], [4, 5], [1, 2])
