"""Landed pages, attribution, state and replaced ranges, by hand-made rows."""

from __future__ import annotations

import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from pulsegrid.operators import attribution, ingest, upserts
from pulsegrid.operators.attribution import Keyword, attribute, keyword_table, models_of, runs_met
from pulsegrid.sources import landed


def test_broken_pages_and_items_are_put_aside_and_none_is_lost(spark, tmp_path):
    pages = [
        '{"hits": [{"objectID": "1", "title": "fine story about things", "created_at": "2024-01-01T00:00:00Z", "points": 3}, {"objectID": null, "title": "no id", "created_at": "2024-01-01T00:00:00Z"}]}',
        '{"hits": [{"objectID": "2", "title": "bad time", "created_at": "soon"}, {"objectID": "3", "title": "missing time"}, {"objectID": "4", "title": "wrong type", "points": "many", "created_at": "2024-01-02T00:00:00Z"}]}',
        '{"hits": [{"objectID": "5", "title": "broke o', "not json at all", '{"other": 1}', '{"hits": null}', "",
    ]
    (tmp_path / "a.json").write_text("\n".join(pages))
    stories = landed.stories(spark, f"file://{tmp_path}")
    aside = sorted((r.reason, r.file.endswith("a.json")) for r in landed.quarantined(stories).collect())
    assert aside == [("no_time", True), ("no_time", True), ("no_url", True), ("unreadable", True), ("unreadable", True)]
    posts = landed.story_posts(stories)
    assert sorted((r.source_url[-1], r.engagement) for r in posts.collect()) == [("1", 3), ("4", 0)]
    assert stories.count() == posts.count() + len(aside)


def test_a_single_hyphenated_keyword_meets_all_its_spellings(spark):
    texts = ["gpt 5 is out", "gpt5!", "GPT-5", "gpt.5", "gpt  5", "agpt-5", "gpt-55", "o4 mini", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for keywords in ([Keyword("chatgpt", "gpt-5")], [Keyword("chatgpt", "gpt-5"), Keyword("other", "o4-mini")]):
        found = {r.id: r.s for r in rows.select("id", models_of(F.coalesce("text", F.lit("")), keywords).alias("s")).collect()}
        assert [i for i, s in found.items() if "chatgpt" in s] == [0, 1, 2, 3]
        table = sorted((r.id, r.slug) for r in attribute(rows, keyword_table(spark, keywords)).collect())
        assert table == sorted((i, x) for i, s in found.items() for x in s)


def test_ten_thousand_keywords_name_what_their_patterns_name(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcde12") for _ in range(rng.randint(1, 4)))
    keywords = {(f"s{rng.randint(0, 50)}", rng.choice(["-", ".", " ", ""]).join(word() for _ in range(rng.randint(1, 3))), rng.choice(["high", "ambiguous"]), rng.choice([None, "zz", " Model , qq"])) for _ in range(10_000)}
    texts = [" ".join(rng.choice(["", "- ", ". ", "_"]) + word() for _ in range(rng.randint(0, 25))) + rng.choice(["", " zz", " MODELS"]) for _ in range(60)] + [None, ""]
    posts = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, slug string")
    found = {(r.id, r.slug) for r in attribute(posts, spark.createDataFrame(list(keywords), "slug string, word string, tier string, context string")).collect()}
    patterns = [(slug, re.compile(r"\b" + re.sub(r"[-.]", r"[-\\s.]?", w) + r"\b", re.ASCII), tier, [c.strip().lower() for c in context.split(",")] if context else None) for slug, w, tier, context in keywords]
    expected = set()
    for i, t in enumerate(texts):
        low = (t or "").lower()
        for slug, pattern, tier, context in patterns:
            if pattern.search(low) and (tier == "high" or context is None or any(c in low for c in context)):
                expected.add((i, slug))
    assert found == expected


def most_rows(df) -> int:
    """The largest number of rows that a step of a run query made."""
    todo, most = [df._jdf.queryExecution().executedPlan().finalPhysicalPlan()], 0
    while todo:
        node = todo.pop()
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        todo += [node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_only_runs_that_may_be_keywords_leave_their_texts(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)) + (" Gpt 5" if i % 10 == 0 else "") for i in range(50)]
    posts = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    found = attribute(posts, keyword_table(spark, [Keyword("chatgpt", "gpt-5"), Keyword("claude", "claude", "ambiguous", ("model",))]))
    assert sorted(map(tuple, found.collect())) == [(i, "chatgpt") for i in range(0, 50, 10)]
    assert most_rows(found) <= 200  # of 20,000 words
    assert "hashpartitioning(id" in found._jdf.queryExecution().executedPlan().toString().partition("MapInArrow")[2]


def test_keywords_too_many_to_be_sent_name_the_same(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ab1") for _ in range(rng.randint(1, 3)))
    keywords = keyword_table(spark, [Keyword(f"s{i % 20}", word() + rng.choice(["-", " ", ""]) + word(), rng.choice(["high", "ambiguous"]), rng.choice([(), ("aab", "1b")])) for i in range(300)])
    posts = spark.createDataFrame([(i, " ".join(word() + rng.choice(["", "-", ","]) for _ in range(rng.randint(0, 8)))) for i in range(200)], "id long, text string")
    few = sorted(map(tuple, attribute(posts, keywords).collect()))
    monkeypatch.setattr(attribution, "FEW", 0)
    many = attribute(posts, keywords)
    assert sorted(map(tuple, many.collect())) == few and len(few) > 100
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()


def test_runs_of_words_with_their_pieces():
    known = {"ab", "abcd", "x1y", "q"}.intersection
    cases = {"ab-cd, ab": {("ab", "ab"), ("abcd", "ab-cd")}, "": set(), "--": set(), "!x.1 y": {("x1y", "x.1 y")}, "q": {("q", "q")}, "x1 y q ": {("x1y", "x1 y"), ("q", "q")}, "a b cd abcd": {("ab", "a b"), ("abcd", "a b cd"), ("abcd", "abcd")}}
    for low, expected in cases.items():
        assert runs_met(low, 3, known) == expected, low
    assert runs_met("ab cd", 1, known) == {("ab", "ab")}


def test_veto_of_local_models_and_communities(spark):
    keywords = [Keyword("chatgpt", "gpt", "ambiguous"), Keyword("chatgpt", "openai", "ambiguous")]
    rows = [(1, "gpt-oss on ollama", "a"), (2, "gpt-oss beside chat gpt", None), (3, "nothing", "a"), (4, None, "b"), (5, "openai and gpt", "zz")]
    posts = spark.createDataFrame(rows, "id long, text string, place string")
    found = attribute(posts, keyword_table(spark, keywords), community="place", communities=spark.createDataFrame([("a", "claude"), ("b", "grok")], "community string, slug string"))
    assert sorted(map(tuple, found.collect())) == [(1, "claude"), (2, "chatgpt"), (3, "claude"), (4, "grok"), (5, "chatgpt")]


def test_posts_and_stored_rows_do_not_pass_through_the_driver(spark):
    at = datetime(2024, 1, 30)
    kind = "source_url string, model_id string, title string, posted_at timestamp, status string, attempts int, next_at timestamp"
    stored = spark.createDataFrame([(f"u{i}", "m0", f"I tested claude on task {i}", at, "classified", 1, None) for i in range(20)], kind)
    posts = spark.createDataFrame([(f"u{i}", f"I tested Claude on task {i % 30}" + " and grok" * (i % 2), None, None, at) for i in range(10, 60)], "source_url string, title string, body string, link string, posted_at timestamp")
    models = spark.createDataFrame([("m0", "claude"), ("m1", "grok")], "model_id string, slug string")
    found = ingest.stored_after(stored, posts, keyword_table(spark, [Keyword("claude", "claude"), Keyword("grok", "grok")]), models, F.lit("2024-01-31").cast("timestamp"))
    new = {(f"u{i}", m) for i in range(20, 60) for m in ["m0", "m1"][: 1 + i % 2] if i % 30 >= 20 or i % 2}
    assert {(r.source_url, r.model_id) for r in found.collect()} == {(f"u{i}", "m0") for i in range(20)} | new
    plan = found._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()
    assert set(re.findall(r"BroadcastHashJoin \[(\w+)", plan)) == {"letters", "slug"}


def test_first_state_of_a_row(spark):
    now = F.lit("2024-01-31").cast("timestamp")
    bare = ingest.with_state(spark.createDataFrame([(1,)], "id long"), now).collect()[0]
    assert (bare.status, bare.attempts, bare.next_at, bare.classified_at) == ("pending", 0, datetime(2024, 1, 31), None)
    rows = spark.createDataFrame([(1, "positive", None), (2, "", None), (3, "positive", "retry"), (4, None, None)], "id long, sentiment string, status string")
    got = {r.id: (r.status, r.attempts, r.classifier_version) for r in ingest.with_state(rows, now).collect()}
    assert got == {1: ("classified", 1, "legacy-inline-v1"), 2: ("pending", 0, None), 3: ("retry", None, None), 4: ("pending", 0, None)}


def test_days_of_a_replaced_range_without_rows_are_emptied(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    kind = "day string, v int"
    spark.createDataFrame([(f"2024-01-0{d}", d) for d in range(1, 7)], kind).write.partitionBy("day").parquet(path)
    read = lambda: sorted((r.day, r.v) for r in spark.read.schema("v int, day string").parquet(path).collect())
    new = spark.createDataFrame([("2024-01-03", 30), ("2024-01-06", 60)], kind)
    for _ in range(2):  # a repeated run gives the same
        upserts.replace_range(path, new, "day", "2024-01-02", "2024-01-04")
        assert read() == [("2024-01-01", 1), ("2024-01-03", 30), ("2024-01-05", 5), ("2024-01-06", 6)]
    upserts.replace_range(path, new.limit(0), "day", "2024-01-03", "2024-01-05")
    assert read() == [("2024-01-01", 1), ("2024-01-06", 6)]


def test_a_mark_that_is_set_stays(spark):
    t = lambda d: datetime(2024, 1, d)
    stored = spark.createDataFrame([(1, "u", t(1)), (2, "u", None), (3, "v", None)], "id long, source_url string, checked_at timestamp")
    got = upserts.checked(stored, stored.where("id = 2"), F.lit("2024-01-09").cast("timestamp"))
    assert {r.id: r.checked_at for r in got.collect()} == {1: t(1), 2: t(9), 3: None}


def test_every_source_puts_aside_what_lacks_url_or_time(spark, tmp_path):
    good = {
        "hackernews": '{"hits": [{"objectID": "1", "created_at": "2024-01-01T00:00:00Z"}, {"objectID": "2"}, {"created_at": "2024-01-01T00:00:00Z"}]}',
        "bluesky": '{"posts": [{"uri": "at://a/1", "record": {"createdAt": "2024-01-01T00:00:00Z"}}, {"uri": "at://a/2", "record": {"createdAt": "x"}}, {"record": {"createdAt": "2024-01-01T00:00:00Z"}}]}',
        "openrouter": '{"data": [{"id": "a/b", "created": 1700000000}, {"id": "a/c"}, {"created": 1700000000}]}',
        "mastodon": '{"url": "u", "created_at": "2024-01-01T00:00:00Z"}\n{"url": "u"}\n{"created_at": "2024-01-01T00:00:00Z"}',
        "twitter": '{"id": "1", "createdAt": "2024-01-01T00:00:00Z"}\n{"id": "1"}\n{"createdAt": "2024-01-01T00:00:00Z"}',
        "reddit": '{"url": "u", "createdAt": "2024-01-01T00:00:00Z"}\n{"postUrl": "u"}\n{"url": "", "createdAt": "2024-01-01T00:00:00Z"}',
        "appstore": '{"id": {"label": "1"}, "updated": {"label": "2024-01-01T00:00:00Z"}}\n{"id": {"label": "1"}}\n{"updated": {"label": "2024-01-01T00:00:00Z"}}',
        "github": '{"html_url": "u", "created_at": "2024-01-01T00:00:00Z"}\n{"html_url": "u", "created_at": 5}\n{"created_at": "2024-01-01T00:00:00Z"}',
    }
    assert set(good) == set(landed.shapes())
    for source, lines in good.items():
        (tmp_path / f"{source}.json").write_text(lines + "\n{broken\n")
        got = sorted(r.reason for r in landed.quarantine(spark, f"file://{tmp_path}/{source}.json", source).collect())
        assert got == ["no_time", "no_url", "unreadable"], source
