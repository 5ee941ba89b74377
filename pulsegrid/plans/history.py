"""Queries over bounded classifier calls, staged samples, agreement, costs, declared successors, zone days and times said in texts."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import lexicons as lex
from pulsegrid.functions import scope, text
from pulsegrid.operators import breakdowns, calls, leaderboard, prices, sampling, scoring
from pulsegrid.plans.rumors import BOARD_SQL, board
from pulsegrid.plans.scores import DAILY_SQL, DAY_SQL, raw_sql
from pulsegrid.plans.views import NOW, now, pick, posts, read, with_posts

N = f"TIMESTAMP '{NOW}'"


def unsteady(texts: list[str]) -> list[dict]:
    """A stand-in for a provider: it fails for some texts, comes short or out of order for some slices, and otherwise goes by words."""
    if any(t.startswith("Post 13 ") for t in texts):
        raise ValueError("503")
    out = [{"index": i, "relevant": "view" not in t, "sentiment": "positive" if "purchase" in t or "signup" in t else "negative" if "error" in t else "neutral"} for i, t in enumerate(texts)]
    kind = zlib.crc32(texts[0].encode()) % 3
    if len(out) > 1 and kind == 0:
        return out[::-1][1:]  # out of order, and the last text has none
    if len(out) > 1 and kind == 1:
        return [{k: v for k, v in r.items() if k != "index"} for r in out[:-1]]  # one short, without places
    return out


def classified_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Posts after a round of calls for all that wait: results written back, the rest as it was."""
    p = posts(spark, folder).withColumn("classified_at", F.when(F.col("status") == "classified", F.col("created_at")))
    said = calls.classify(p.where(F.col("status").isin("pending", "retry")), unsteady)
    field = lambda name: F.get_json_object("said", f"$.{name}")
    results = said.select(
        "id", F.when(F.col("error").isNull(), "ok").otherwise(F.split_part("error", F.lit(":"), F.lit(1))).alias("result_status"), (field("relevant") == "true").alias("relevant"), field("sentiment").alias("result_sentiment"),
        F.lit(0.9).alias("result_confidence"), F.col("error").alias("result_error"), F.lit(None).cast("long").alias("retry_after_ms"),
    )
    return calls.written_back(p, results, now())


CALLS_SQL = f""", due AS (SELECT *, status IN ('pending', 'retry') AS hit, title LIKE 'Post 13 %' AS bad, event_type_of AS kind, attempts + 1 AS n FROM (SELECT *, regexp_extract(title, 'about (.*)$', 1) AS event_type_of FROM posts))
SELECT id, CASE WHEN NOT hit THEN status WHEN bad THEN CASE WHEN n >= 5 THEN 'failed' ELSE 'retry' END WHEN kind = 'view' THEN 'irrelevant' ELSE 'classified' END AS status, CASE WHEN hit THEN n ELSE attempts END AS attempts,
  CASE WHEN NOT hit THEN next_at WHEN bad AND n < 5 THEN {N} + to_seconds((900 * power(2, n - 1))::BIGINT) END AS next_at, CASE WHEN hit AND NOT bad THEN {N} WHEN NOT hit AND status = 'classified' THEN created_at END AS classified_at,
  CASE WHEN NOT hit THEN error WHEN bad THEN 'classifier_error: 503' END AS error,
  CASE WHEN NOT hit THEN sentiment WHEN bad OR kind = 'view' THEN NULL WHEN kind IN ('purchase', 'signup') THEN 'positive' WHEN kind = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment,
  CASE WHEN NOT hit THEN confidence WHEN bad THEN NULL WHEN kind = 'view' THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM due"""

STAGES = [("foreign", "id % 9 = 0", 3), ("several", "id % 7 < 2", 4), ("hard", "confidence < 0.65", 5), ("easy", "confidence >= 0.9", 6), ("any", "true", 20)]
TARGET = 20


def staged_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty posts of each model by overlapping quotas."""
    rows = posts(spark, folder).where("status = 'classified'")
    return sampling.staged(rows, "model_id", [(n, F.expr(c), q) for n, c, q in STAGES], TARGET, "id").select("id", "model_id", "stage")


def _staged_sql() -> str:
    before, steps = "SELECT *, NULL::VARCHAR AS stage FROM posts WHERE status = 'classified'", []
    for k, (name, condition, quota) in enumerate(STAGES):
        steps.append(f"t{k} AS (SELECT * REPLACE (CASE WHEN stage IS NULL AND {condition} AND place <= least({quota}, {TARGET} - taken) THEN '{name}' ELSE stage END AS stage) FROM (SELECT *, count(*) FILTER (WHERE stage IS NULL AND {condition}) OVER (PARTITION BY model_id ORDER BY id) AS place, count(stage) OVER (PARTITION BY model_id) AS taken FROM ({before})))")
        before = f"SELECT * EXCLUDE (place, taken) FROM t{k}"
    return f", {', '.join(steps)} SELECT id, model_id, stage FROM t{len(STAGES) - 1} WHERE stage IS NOT NULL"


def agreement_report(spark: SparkSession, folder: str) -> DataFrame:
    """A made-up second classifier against the stored results."""
    p, i = posts(spark, folder).where("status = 'classified'"), F.col("id")
    stored = p.select("id", "sentiment", "complaint", "praise", pick(["en", "de", "", "fr"], i % 4).alias("language"))
    other = p.where(i % 31 != 0).select(
        "id", F.when(i % 23 == 0, "timeout").otherwise("ok").alias("status"), (i % 19 != 0).alias("relevant"), F.when(i % 5 == 0, "neutral").otherwise(F.col("sentiment")).alias("sentiment"), F.when(i % 4 == 0, "speed").otherwise(F.col("complaint")).alias("complaint"),
        F.when(i % 3 != 0, F.col("praise")).alias("praise"), pick(["", "de", "en", "es"], i % 4).alias("language"), F.when(i % 2 == 0, "a translation").otherwise("short").alias("translation"),
    )
    return breakdowns.agreement_report(stored, other, "id")


AGREEMENT_SQL = """, b AS (SELECT id, sentiment AS s, complaint AS c, praise AS p, (['en', 'de', '', 'fr'])[id % 4 + 1] AS l, id % 31 = 0 OR id % 23 = 0 AS failed, id % 19 <> 0 AS rel, CASE WHEN id % 5 = 0 THEN 'neutral' ELSE sentiment END AS s2, CASE WHEN id % 4 = 0 THEN 'speed' ELSE complaint END AS c2, CASE WHEN id % 3 <> 0 THEN praise END AS p2,
  id % 2 = 0 AS long FROM posts WHERE status = 'classified'), v AS (SELECT *, NOT failed AND rel AS seen FROM b)
SELECT count(*) AS sample_size, count(*) FILTER (failed) AS failures, count(*) FILTER (NOT failed AND NOT rel) AS newly_irrelevant, count(*) FILTER (seen) AS comparable, round(avg((s = s2)::INT::DOUBLE) FILTER (seen), 3) AS sentiment_rate,
  round(avg((s = s2)::INT::DOUBLE) FILTER (seen AND s = 'positive'), 3) AS positive_rate, round(avg((s = s2)::INT::DOUBLE) FILTER (seen AND s = 'negative'), 3) AS negative_rate, round(avg((s = s2)::INT::DOUBLE) FILTER (seen AND s = 'neutral'), 3) AS neutral_rate,
  round(avg((c = c2)::INT::DOUBLE) FILTER (seen AND s = 'negative' AND c <> 'other'), 3) AS complaint_rate, round(avg((p2 IS NOT NULL)::INT::DOUBLE) FILTER (seen AND s = 'positive'), 3) AS praise_rate, round(avg((id % 4 <> 3)::INT::DOUBLE) FILTER (seen), 3) AS language_rate, round(avg(long::INT::DOUBLE) FILTER (seen AND id % 4 IN (1, 3)), 3) AS translation_rate FROM v"""


def cost_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Costs of usage, made of line items, by a history of prices, made of orders' years, with a gap and a price without end."""
    li = read(spark, folder, "lineitem")
    usage = li.select(F.concat(F.lit("m"), F.col("l_suppkey") % 3).alias("model"), F.col("l_shipdate").cast("timestamp").alias("at"), (F.col("l_quantity") * 100).alias("input"), F.col("l_extendedprice").alias("output"), F.col("l_quantity").alias("cached"))
    years = read(spark, folder, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    held = years.select(F.explode(F.array(*(F.struct(F.lit(f"m{m}").alias("model"), F.lit(m).alias("m")) for m in range(2)))).alias("p"), "y").select(
        "p.model", F.make_timestamp("y", F.lit(3), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("since"), F.when(F.col("y") < 1998, F.make_timestamp(F.col("y") + 1, F.col("p.m") + 2, F.lit(1), F.lit(0), F.lit(0), F.lit(0))).alias("until"),
        (F.col("y") - 1990.0).alias("input_price"), (F.col("y") - 1985.0).alias("output_price"),
    )
    return prices.by_day(usage, held).withColumn("day", F.col("day").cast("string"))


COST_SQL = """WITH u AS (SELECT row_number() OVER () AS a, 'm' || (l_suppkey % 3) AS model, l_shipdate AS tm, l_quantity * 100 AS i, l_extendedprice AS o, l_quantity AS c FROM lineitem),
p AS (SELECT 'm' || m AS model, make_timestamp(y, 3, 1, 0, 0, 0) AS since, CASE WHEN y < 1998 THEN make_timestamp(y + 1, m + 2, 1, 0, 0, 0) END AS until, y - 1990.0::DOUBLE AS ip, y - 1985.0::DOUBLE AS op FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders), range(2) r(m)),
c AS (SELECT u.*, ((i - c) * ip + c * ip * 0.1::DOUBLE + o * op) / 1000000 AS cost FROM u LEFT JOIN p ON p.model = u.model AND p.since <= u.tm AND (p.until IS NULL OR p.until > u.tm) QUALIFY row_number() OVER (PARTITION BY a ORDER BY since DESC) = 1)
SELECT model, tm::DATE::VARCHAR AS day, count(*) AS calls, count(*) FILTER (cost IS NULL) AS unpriced, round(sum(cost), 9) AS cost, round(round(sum(cost), 9) / nullif(count(cost), 0) * 1000, 9) AS cost_per_1k FROM c GROUP BY ALL"""


def lineup_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Models with the next and the last of their line: some declare a successor, some of these chains are circles, some models are baselines."""
    k = F.col("k")
    said = F.when(k % 6 == 1, F.concat(F.lit("n"), k + 3)).when((k % 6 == 4) & (k % 4 == 0), F.concat(F.lit("n"), k - 3)).when(k % 17 == 0, F.concat(F.lit("n"), k)).when(k % 19 == 0, "gone")
    rows = board(spark, folder).select("name", "label", "ranked", (k % 13 == 0).alias("is_baseline"), said.alias("superseded_by"))
    return leaderboard.lineup(rows)


LINEUP_SQL = f"""WITH RECURSIVE {BOARD_SQL}, b AS (SELECT *, k % 13 = 0 AS base, CASE WHEN k % 6 = 1 THEN 'n' || (k + 3) WHEN k % 6 = 4 AND k % 4 = 0 THEN 'n' || (k - 3) WHEN k % 17 = 0 THEN 'n' || k WHEN k % 19 = 0 THEN 'gone' END AS said FROM board),
r AS (SELECT * FROM b WHERE ranked AND NOT base), t AS (SELECT fam, max(ver) AS tv, arg_max(name, (ver, name)) AS tn FROM r GROUP BY fam),
s AS (SELECT b.name, CASE WHEN base THEN NULL WHEN said <> b.name AND said IN (SELECT name FROM r) THEN said WHEN tv > ver AND tn <> b.name THEN tn END AS successor FROM b LEFT JOIN t USING (fam)),
w AS (SELECT name, successor AS at, 1 AS n FROM s WHERE successor IS NOT NULL UNION ALL SELECT w.name, s.successor, n + 1 FROM w JOIN s ON s.name = w.at WHERE s.successor IS NOT NULL AND n < 60),
e AS (SELECT w.name, w.at FROM w JOIN s ON s.name = w.at WHERE s.successor IS NULL)
SELECT s.name, s.successor, e.at AS final FROM s LEFT JOIN e USING (name)"""

SHIFT = "68 days"


def zone_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Daily scores of posts moved to a month in which the zone's clocks change."""
    moved = posts(spark, folder).withColumn("posted_at", F.col("posted_at") + F.expr(f"interval {SHIFT}"))
    rows = scoring.daily(moved).select("model_id", "period_start", "score", "total_posts")
    window = scoring.day_window(rows, "period_start")
    return window.select("model_id", "period_start", "score", "total_posts", "label", ((F.col("range_end").cast("long") - F.col("range_start").cast("long")) / 3600).alias("hours"), (F.col("range_start") == F.col("period_start")).alias("starts_there"))


_LOCAL = f"timezone('{scoring.ZONE}', timezone('UTC', posted_at + INTERVAL {SHIFT}))"
_ZONED = DAILY_SQL.replace(raw_sql(DAY_SQL), raw_sql(f"timezone('UTC', timezone('{scoring.ZONE}', date_trunc('day', {_LOCAL})))"))


def wall_times(spark: SparkSession, folder: str) -> DataFrame:
    """Instants of wall times on the days of posts, moved to both changes of the clocks."""
    day = lambda shift: F.date_format(F.to_date("posted_at") + F.expr(f"interval {shift} days"), "yyyy-MM-dd")
    rows = posts(spark, folder).select(F.explode(F.array(day(50), day(290))).alias("label")).distinct()
    rows = rows.withColumn("time", F.explode(F.array(*map(F.lit, ("00:00", "01:30", "02:30", "12:00")))))
    return scoring.with_instant(rows, "label", "time", scoring.ZONE, "instant")


_OFFSET = "(epoch(timezone('{z}', timezone('UTC', {g}))) - epoch({g}))::BIGINT"


def _wall_sql() -> str:
    days = "SELECT DISTINCT strftime(posted_at::DATE + to_days(s), '%Y-%m-%d') AS label FROM posts, (VALUES (50), (290)) v(s)"
    step, guess = f"SELECT label, time, (label || ' ' || time || ':00')::TIMESTAMP AS base, (label || ' ' || time || ':00')::TIMESTAMP AS g FROM ({days}), (VALUES ('00:00'), ('01:30'), ('02:30'), ('12:00')) t(time)", "g"
    for _ in range(4):
        step = f"SELECT label, time, base, base - to_seconds({_OFFSET.format(z=scoring.ZONE, g=guess)}) AS g FROM ({step})"
    return f" SELECT label, time, g AS instant FROM ({step})"


TELLS = [
    "Gemini 3.5 Pro slipped to mid-July; enterprise partners wait. Other news in July.", "we hear 3.5 pro is coming. next week is close", "gemini3, 5 PRO spotted in the arena\nnothing else", "no version here, July anyway",
    "the 3.5 Pro rumor", "Gemini 3.5 Pro exists", "Give us until the second week of July for Gemini 3.5 Pro, they said",
]


def claims_said(spark: SparkSession, folder: str) -> DataFrame:
    """Claims recovered from documents into whose middle a sentence was put."""
    d, i = read(spark, folder, "documents"), F.col("doc_id")
    t = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    rows = d.select("doc_id", F.concat(F.substring(t, F.lit(1), half), F.when(i % 2 == 0, ". ").otherwise(" "), pick(TELLS, i % len(TELLS)), F.lit(" "), F.substring(t, half + 1, F.length(t))).alias("text"))
    return scope.recovered_claims(rows).select("doc_id", "version_label", "claim_type", "claim_summary", "eta_text")


def _said_sql() -> str:
    has = lambda c, p: text.has_sql(c, p)
    eta = lambda c: "CASE " + " ".join(f"WHEN {has(c, p)} THEN '{n}'" for p, n in lex.ETA_SAID) + " END"
    kind = "CASE " + " ".join(f"WHEN {has('win', p)} THEN '{n}'" for n, p in (("delayed", lex.DELAY_SAID), ("in_testing", lex.TESTING_SAID), ("imminent", lex.IMMINENT_SAID), ("launch", lex.LAUNCH_SAID))) + " END"
    last = lambda m: f"CASE WHEN contains(pre, {m}) THEN length(pre) - strpos(reverse(pre), reverse({m})) - length({m}) + 1 ELSE -1 END"
    after = lambda m: f"CASE WHEN contains(post, {m}) THEN e + strpos(post, {m}) - 1 END"
    quoted = "[" + ", ".join("'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for t in TELLS) + "]"
    return f"""WITH d AS (SELECT doc_id, substring(x, 1, (length(x) // 2)::INTEGER) || CASE WHEN doc_id % 2 = 0 THEN '. ' ELSE ' ' END || ({quoted})[doc_id % {len(TELLS)} + 1] || ' ' || substring(x, (length(x) // 2)::INTEGER + 1) AS t FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)),
m AS (SELECT *, regexp_extract(t, '(?i){lex.VERSION_SAID}') AS said FROM d), p AS (SELECT *, strpos(t, said) - 1 AS a, substring(t, 1, strpos(t, said) - 1) AS pre, strpos(t, said) - 1 + length(said) AS e, substring(t, strpos(t, said) + length(said)) AS post FROM m WHERE said <> ''),
b AS (SELECT *, greatest({last('chr(10)')}, {last("'. '")}, {last("'; '")}) AS l, least({after('chr(10)')}, {after("'.'")}, {after("'; '")}) AS r FROM p),
w AS (SELECT *, CASE WHEN r > l AND r - l <= 360 THEN substring(t, l + 2, r - l) ELSE substring(t, greatest(0, a - 180) + 1, e + 180 - greatest(0, a - 180)) END AS win FROM b),
k AS (SELECT *, {kind} AS claim_type, coalesce({eta('win')}, {eta('t')}) AS eta_text FROM w)
SELECT doc_id, CASE WHEN said ILIKE 'gemini%' THEN 'Gemini 3.5 Pro' ELSE '3.5 Pro' END AS version_label, claim_type, eta_text, CASE claim_type WHEN 'delayed' THEN CASE WHEN eta_text IS NULL THEN 'Gemini 3.5 Pro is delayed.' ELSE 'Gemini 3.5 Pro is delayed to ' || eta_text || '.' END
  WHEN 'in_testing' THEN 'Gemini 3.5 Pro is being discussed as in testing.' WHEN 'imminent' THEN 'Gemini 3.5 Pro is being discussed as imminent.' ELSE 'Gemini 3.5 Pro is being discussed as an upcoming release.' END AS claim_summary FROM k WHERE claim_type IS NOT NULL"""


QUERIES = {
    "classified_calls": classified_calls,
    "staged_sample": staged_sample,
    "agreement_report": agreement_report,
    "cost_by_day": cost_by_day,
    "lineup_chains": lineup_chains,
    "zone_scores": zone_scores,
    "wall_times": wall_times,
    "claims_said": claims_said,
}
ORACLE = {
    "classified_calls": with_posts(CALLS_SQL),
    "staged_sample": with_posts(_staged_sql()),
    "agreement_report": with_posts(AGREEMENT_SQL),
    "cost_by_day": COST_SQL,
    "lineup_chains": LINEUP_SQL,
    "zone_scores": with_posts(f"{_ZONED} SELECT model_id, period_start, score, total_posts, strftime(timezone('{scoring.ZONE}', timezone('UTC', period_start)), '%Y-%m-%d') AS label, CASE strftime(timezone('{scoring.ZONE}', timezone('UTC', period_start)), '%Y-%m-%d') WHEN '2024-03-10' THEN 23.0::DOUBLE WHEN '2024-11-03' THEN 25.0::DOUBLE ELSE 24.0::DOUBLE END AS hours, true AS starts_there FROM scores"),
    "wall_times": with_posts(_wall_sql()),
    "claims_said": _said_sql(),
}
