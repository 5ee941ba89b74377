"""Identities, validation, origins and dates of rumours, by hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import text
from pulsegrid.operators import canon, results, rumors, runs, scoring


@pytest.mark.parametrize(
    ("label", "parts"),
    [
        ("Mythos/Fable 5", ["Mythos 5", "Fable 5"]), ("Sonnet 5 or Opus 5", ["Sonnet 5", "Opus 5"]), ("GPT-5.6", ["GPT-5.6"]), (None, []), ("  ", []), ("a aka b, c & d", ["a", "b", "c", "d"]),
        ("Doctor orders", ["Doctor orders"]), ("A / B 2.5", ["A 2.5", "B 2.5"]),
    ],
)
def test_compound_labels(spark, label, parts):
    assert spark.createDataFrame([(label,)], "label string").select(canon.split_label(F.col("label"))).first()[0] == parts


CANON = [
    ("claude", "Mythos/Fable 5", None, "fable5", "Fable 5"), ("claude", None, "Mythos", "fable5", "Fable 5"), ("chatgpt", "GPT-6 Sol", "Sol", "gpt6", "GPT-6"), ("chatgpt", "GPT-6 Mini", None, "gpt6mini", "GPT-6 Mini"),
    ("chatgpt", "6", None, "gpt6", "GPT-6"), ("chatgpt", "GPT-6,5", None, "gpt65", "GPT-6.5"), ("gemini", "Gemini 3.5", None, "gemini35pro", "Gemini 3.5 Pro"), ("grok", "Grok 9", None, "grok9", "Grok 9"), ("grok", "x", None, None, "x"),
]


def test_canonical_keys(spark):
    rows = spark.createDataFrame([(i, f, lb, c) for i, (f, lb, c, _, _) in enumerate(CANON)], "id int, family string, label string, codename string")
    got = {r.id: (r.key, r.canon_label) for r in canon.canonical(rows, canon.catalogue(spark)).collect()}
    assert got == {i: x[3:] for i, x in enumerate(CANON)}


def test_a_claim_must_hold_in_its_text(spark):
    base = {"family": "claude", "label": "Opus 9", "codename": None, "text": "Leaked: opus-9 is in testing", "quality": "unknown", "claim_mode": "report", "evidence_kind": "none", "confidence": 0.9, "is_rumor": True, "is_unreleased": True}
    cases = [
        ({}, None), ({"is_rumor": False}, "no rumour"), ({"is_unreleased": None}, "said to be released"), ({"family": "mistral"}, "unknown family"), ({"claim_mode": "speculation"}, "speculation"),
        ({"claim_mode": None, "text": "I think opus 9 is near."}, "speculation"), ({"claim_mode": None, "text": "I think so. Opus 9 was spotted."}, None), ({"claim_mode": None, "quality": "official", "text": "I think opus 9 is near"}, None),
        ({"claim_mode": "inference"}, "inference without evidence"), ({"confidence": 0.5}, "low confidence"), ({"confidence": None}, None), ({"text": "nothing of it"}, "label not in text"),
        ({"label": "DeepSeek V9", "text": "deepseek v9 leaks"}, "foreign model"), ({"label": "Badoo", "text": "badoo"}, "foreign model"), ({"label": "yi", "text": "yi"}, "foreign model"), ({"label": "Claude Sonnet 5", "text": "claude sonnet 5"}, "released"), ({"label": None, "codename": "x"}, "no identity"),
    ]
    schema = "id int, family string, label string, codename string, text string, quality string, claim_mode string, evidence_kind string, confidence double, is_rumor boolean, is_unreleased boolean"
    rows = spark.createDataFrame([(i, *(base | change).values()) for i, (change, _) in enumerate(cases)], schema)
    got = {r.id: r.rejected for r in canon.rejection(rows, canon.catalogue(spark)).collect()}
    assert got == {i: why for i, (_, why) in enumerate(cases)}


def test_origins_tie_accounts_posts_and_domains_together(spark):
    rows = [
        (1, "twitter", "@Ann", "https://x.com/ann/status/11", None), (2, "twitter", None, "https://x.com/Ann/status/12", None), (3, "reddit", "r1", "https://reddit.com/1", "11"), (4, "bluesky", None, "https://bsky.app/profile/z.org/post/9", None),
        (5, "web", None, "https://www.site.org/a", None), (6, "web", "bob", "https://site.org/b", None), (7, "github", None, "https://github.com/x", None), (8, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, platform string, handle string, url string, quoted string").withColumn("scope", F.lit("s"))
    got = canon.with_component(df, ["scope"], canon.origin_tokens(F.col("platform"), F.col("handle"), F.col("url"), F.col("quoted")), "origin").collect()
    groups: dict = {}
    for r in got:
        groups.setdefault(r.origin, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4], [5, 6], [7], [8]]


ETA = [("week of June 3rd", "Week of Jun 3, 2026"), ("by Sep 30, 2027", "By Sep 30, 2027"), ("early January", "Early-January 2027"), ("sometime in august", "August 2026"), ("Q4", "Q4 2026"), ("as early as next week", "As early as the week of May 18, 2026"),
       ("this week", "Week of May 11, 2026"), ("next month", "June 2026"), ("July 4", "Jul 4, 2026"), ("~new target is soon", "Soon"), ("", None), (None, None)]


def test_expected_dates_in_words(spark):
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(ETA)], "id int, said string").withColumn("seen", F.lit("2026-05-14 10:00:00").cast("timestamp"))
    got = {r.id: r.eta for r in rumors.with_eta(rows, "said", "seen").collect()}
    assert got == {i: e for i, (_, e) in enumerate(ETA)}


def test_numeric_entities_and_classifier_answers(spark):
    assert spark.range(1).select(text.decoded(F.lit("&#8220;a&#x201d; &#; &#x1F600; &amp;"))).first()[0] == "“a” &#; 😀 &amp;"
    said = ['{"relevant": true, "sentiment": "negative", "confidence": 1.5, "complaint_category": "odd"}', '{"relevant": false}', '{"sentiment": "x"}', "[]", None, '{"relevant": true, "sentiment": "positive"}']
    got = results.validated(spark.createDataFrame(list(enumerate(said)), "id int, said string")).orderBy("id").collect()
    assert [(r.status, r.error) for r in got] == [("classified", None), ("irrelevant", None), ("parse_error", "missing_relevant_boolean"), ("parse_error", "result_not_object"), ("parse_error", "result_not_object"), ("parse_error", "missing_confidence")]
    assert (got[0].confidence, got[0].complaint_category, got[1].confidence) == (1.0, "other", 0.0)


def test_runs_with_errors(spark):
    cases = [('{"posts_found": 3}', "success"), ('{"errors": ["x"], "posts_found": 3}', "partial"), ('{"errors": ["x"]}', "failed"), ('{"skipped": true, "errors": ["x"]}', "skipped"), ('{"filtered": 2, "errors": ["quota"], "classificationQueued": 1}', "partial"), ('{"filtered": 2, "errors": ["quota"], "posts_found": 9}', "failed"), ("{}", "success")]
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "id int, summary string")
    assert [r.run_status for r in runs.metrics(rows).orderBy("id").collect()] == [x for _, x in cases]


def test_smoothing_goes_on_from_a_stored_seed(spark):
    rows = spark.createDataFrame([("m", "2026-01-01", 100, 1)], "model_id string, d string, raw_score int, eligible_posts long").withColumn("period_start", F.col("d").cast("timestamp"))
    seeds = spark.createDataFrame([("m", 36)], "model_id string, seed int")
    assert scoring.smooth(rows, seeds).first().score == 49
    assert scoring.smooth(rows).first().score == 100
