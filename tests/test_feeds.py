"""Feeds, comments, lists, prices and repairs, by hand-made rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pulsegrid.functions import taxonomy, text
from pulsegrid.operators import ingest, leaderboard, monitor, products, queue
from pulsegrid.operators.attribution import Keyword, keyword_table
from pulsegrid.plans import landed as plans_landed
from pulsegrid.sources import landed


def test_comments_have_urls_of_their_own(spark, tmp_path):
    rows = [
        '{"id": "c1", "dataType": "comment", "body": "long enough to be a comment", "communityName": "A", "upVotes": 0, "score": 4, "createdAt": "2024-01-02T00:00:00Z", "postUrl": "https://r/p"}',
        '{"id": "c2", "dataType": "comment", "body": "long enough to be a comment", "createdAt": "2024-01-02T00:00:00Z", "commentUrl": "https://r/p/c2", "parsedCommunityName": "B"}',
        '{"id": null, "dataType": "comment", "body": "long enough to be a comment", "createdAt": "2024-01-02T00:00:00Z", "url": "https://r/q"}',
        '{"id": "c3", "dataType": "comment", "body": "too short", "createdAt": "2024-01-02T00:00:00Z", "url": "https://r/q"}',
        '{"id": "c4", "dataType": "comment", "body": "long enough to be a comment", "createdAt": "2023-01-02T00:00:00Z", "url": "https://r/old"}',
        '{"id": "c5", "dataType": "comment", "body": "long enough to be a comment", "createdAt": "2024-01-02T00:00:00Z"}', '{"id": "p", "dataType": "post", "body": "long enough to be a comment", "url": "https://r/x"}', "broken",
    ]
    (tmp_path / "c.json").write_text("\n".join(rows))
    got = landed.reddit_comments(spark, f"file://{tmp_path}", F.lit("2024-01-01").cast("timestamp")).collect()
    assert sorted((r.source_url, r.community, r.engagement) for r in got) == [("https://r/p#c1", "A", 4), ("https://r/p/c2", "B", 0), ("https://r/q", "", 0)]


def test_a_comment_must_itself_name_a_model(spark):
    said = [("u1", "I used claude at work and liked it", "x"), ("u2", "the title named it, this comment doesn't", "x"), ("u3", "nothing named, but said in its room", "room"), ("u4", "grok", "x"), ("u5", None, "room"), ("u6", "I tried claude again this very morning", "x")]
    rows = spark.createDataFrame([(u, b, c, datetime(2024, 1, 1 + i)) for i, (u, b, c) in enumerate(said)], "source_url string, body string, community string, posted_at timestamp")
    keywords, rooms = keyword_table(spark, [Keyword("claude", "claude"), Keyword("grok", "grok")]), spark.createDataFrame([("room", "grok")], "community string, slug string")
    assert sorted((r.source_url, r.slug) for r in ingest.named(rows, keywords).collect()) == [("u1", "claude"), ("u6", "claude")]
    assert sorted((r.source_url, r.slug) for r in ingest.named(rows, keywords, 2, rooms).collect()) == [("u3", "grok"), ("u6", "claude")]


def test_release_feed_and_pairs(spark, tmp_path):
    items = ["<item><title>Introducing X</title><category>PRODUCT</category><description> out now </description><pubDate>Mon, 05 Jan 2026 10:00:00 +0000</pubDate></item>", "<item><title> </title><category>Product</category></item>", "<item><title>Talk</title><category>Company</category></item>", "<item><title>No date</title><category> product</category><pubDate>soon</pubDate></item>"]
    (tmp_path / "feed.xml").write_text("<rss>" + "".join(items) + "</rss>")
    got = sorted((r.title, r.description, r.published_at) for r in landed.release_items(spark, f"file://{tmp_path}/feed.xml").collect())
    assert got == [("Introducing X", "out now", datetime(2026, 1, 5, 10)), ("No date", "", None)]
    (tmp_path / "pairs.json").write_text('[{"a": "x", "b": "y", "delta": 0.5, "holm_p": 0.01, "winner": "x"}, {"a": "x"}, {"a": "z", "b": "q", "lo": "wrong"}]')
    assert sorted((r.a, r.b, r.p) for r in landed.pairwise(spark, f"file://{tmp_path}/pairs.json").collect()) == [("x", "y", 0.01), ("z", "q", None)]


def test_registries_of_one_file_each_and_in_streams(spark, tmp_path):
    entry = "  - name: \"model {}\"\n    vendor: 'v'\n    price_pending:\n      date: 2024-01-01\n      note: a: \"b\n    none:\n    ranked: true \n"
    one = {"name": "model {}", "vendor": "v", "price_pending.date": "2024-01-01", "price_pending.note": 'a: "b', "ranked": "true"}
    files = {"alone.yml": ["models:\n" + entry.format(0)], "empty.yml": [""], "stream.yml": [f"---\nmodels:\n{''.join(entry.format(f'{d}.{i}') for i in range(d % 3))}\n" for d in range(2000)], "loose.yml": ["models:\n" + entry.format("a") + "--- \nmodels:\n" + entry.format("b") + "---\n"]}
    for name, documents in files.items():
        (tmp_path / name).write_text("".join(documents))
    names = ["0", "a", "b", *(f"{d}.{i}" for d in range(2000) for i in range(d % 3))]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")  # a stream is read in many tasks
    try:
        read = landed.registry(spark, f"file://{tmp_path}")
        assert read.rdd.getNumPartitions() > 10
        found = [r.entry for r in read.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_name = lambda rows: sorted(rows, key=lambda x: x["name"])
    assert by_name(found) == by_name([one | {"name": f"model {n}"} for n in names])


def test_registries_land_in_few_files(spark, tmp_path, monkeypatch):
    landed_in = []
    monkeypatch.setattr(plans_landed, "write_text", lambda *a, f=plans_landed.write_text: landed_in.append(f(*a)) or landed_in[-1])
    rows = plans_landed.landed_registry(spark, "/root/testdata/sf0.01")
    assert rows.count() == rows.select("name").distinct().count() == 10_000
    text = spark.read.text(landed_in[0])
    assert text.where("value = 'models:'").count() == 250
    assert len(text.inputFiles()) <= spark.sparkContext.defaultParallelism  # not 250


def test_prices_of_the_test_and_to_come(spark):
    models = spark.createDataFrame([("same", 1.25, 1.0, 2.0), ("dearer", 2.0, 1.0, 2.0), ("untested", 3.0, None, 2.0), ("alone", 4.0, 5.0, 6.0), ("free", 5.0, None, None)], "name string, score double, price_in double, price_out double")
    registry = spark.createDataFrame([("same", 1.0, 2.0, None, None, None), ("dearer", 1.5, None, 9.0, None, "2026-01-01"), ("untested", 7.0, 8.0, None, None, "2026-01-01")], "name string, price_in double, price_out double, pending_in double, pending_out double, effective string")
    got = {r.name: tuple(r)[2:] for r in leaderboard.priced(models, registry).collect()}
    none = (None,) * 5
    assert got == {"same": (1.0, 2.0, *none), "dearer": (1.5, 2.0, 1.0, 2.0, 9.0, None, "2026-01-01"), "untested": (7.0, 8.0, *none), "alone": (5.0, 6.0, *none), "free": (0.0, 0.0, *none)}


def test_lists_of_sources_keep_products_without_any(spark):
    kind = "id long, s array<struct<url:string,rank:int,score:int>>"
    rows = spark.createDataFrame([(1, [("a", 1, 5), ("b", 2, None), ("a", 3, 0), ("", 9, 9)]), (2, None), (3, []), (4, [(None, 1, 1)])], kind)
    got = {r.id: (r.n_urls, r.top) for r in products.listed_sources(rows, ["id"], "s", 1).collect()}
    assert got == {1: (2, ["a"]), 2: (0, []), 3: (0, []), 4: (0, [])}
    both = spark.createDataFrame([([1], [2]), (None, [2]), ([1], None)], "a array<int>, b array<int>")
    assert [r[0] for r in both.select(products.all_claims(F.col("a"), F.col("b"))).collect()] == [[1, 2], [2], [1]]


def test_recent_pages(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    rows = spark.createDataFrame([(i, "m" if i != 3 else "?", "" if i == 4 else f"t{i}", None, datetime(2024, 1, i)) for i in range(1, 32)], "id long, model_id string, title string, content string, posted_at timestamp")
    models = spark.createDataFrame([("m", "claude")], "model_id string, slug string")
    ids = lambda **k: [r.id for r in queue.recent_targeted(rows, models, now, **k).orderBy(F.desc("id")).collect()]
    assert ids(days=3) == [31, 30, 29] and ids(days=0) == [31] and ids(days=99, size=2) == [31, 30]
    assert ids(days=30, before=F.lit("2024-01-06").cast("timestamp"), size=4) == [5, 2]


def test_words_for_sources_and_times(spark):
    t = lambda *a: datetime(2024, 1, *a)
    cases = [(t(10, 12), "just now"), (t(10, 11, 59, 30), "just now"), (t(10, 11, 1), "59m ago"), (t(9, 13), "23h ago"), (t(8, 12), "2d ago"), (t(11), "just now"), (None, "")]
    rows = spark.createDataFrame(cases, "at timestamp, said string").withColumn("got", taxonomy.time_ago(F.col("at"), F.lit("2024-01-10 12:00:00").cast("timestamp")))
    assert rows.where("said <> got").count() == 0
    words = spark.createDataFrame([("twitter",), ("new",), (None,)], "s string").select(taxonomy.source_label(F.col("s")), taxonomy.in_order(F.col("s"), ["new", "twitter"])).collect()
    assert [tuple(r) for r in words] == [("𝕏", 1), ("new", 0), (None, 99)]


def test_noise_and_objects_without_nulls(spark):
    rows = spark.createDataFrame([("summary", True), ("match-debug", True), ("fetch-retry", True), ("retry-fetch", False), ("fetch", False), (None, False)], "c string, noise boolean")
    assert rows.where(monitor.is_noise(F.col("c")) != F.col("noise")).count() == 0
    assert spark.range(1).select(monitor.without_nulls(a=F.lit(1), b=F.lit(None).cast("int"))).first()[0] == '{"a":1}'


def test_a_stored_quality_goes_before_inference(spark):
    rows = spark.createDataFrame([("official", "official"), ("made up", "artifact_leak"), (None, "artifact_leak")], "stored string, q string")
    found = rows.withColumn("got", text.source_quality(F.lit(None), F.lit(None), F.lit("github"), F.lit(False), F.col("stored")))
    assert found.where("got <> q").count() == 0
