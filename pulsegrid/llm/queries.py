"""The queries of the training-data operators: name to (spark, folder of the tables) -> DataFrame, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import backoff_lm, bpe_dp, filter_audit, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash_bktree, spelling, toxicity_fm, url_filter, vector_hnsw
from pulsegrid.llm.common import held_out


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a vocabulary file lies; it's installed on every machine and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity_fm.fit(docs, table(spark, folder, "labels"))
    scored = toxicity_fm.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    index = line_dedup.LineIndex.build(docs, min_docs=10, min_chars=1)
    kept = line_dedup.drop_frequent_lines(docs, index, ["doc_id"])
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_zip(range(len(l)), l)) AS z FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) s,
       LATERAL (SELECT z[1] AS pos, z[2] AS line) u
), frequent AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (key) GROUP BY doc_id
"""


def op3_hnsw(spark: SparkSession, folder: str) -> DataFrame:
    return vector_hnsw.nearest(table(spark, folder, "embeddings"), every=50, k=5)


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_bktree.components(table(spark, folder, "documents"), shingle=3, radius=3)


#: The tree of the mixing query, its weights, the part of all tokens to spend, epochs and seed.
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "domain": {"d0": 3.0, "d1": 2.0, "d2": 2.0}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 2, 1


def mix_levels(lang: str = "lang", source: str = "source") -> dict[str, Column]:
    """The tree's columns from the root down; sources whose names end in one digit are a domain."""
    domain = F.concat(F.lit("d"), F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]?)$", 1))
    return dict(zip(MIX_LEVELS, (domain, F.col(lang), F.col(source)), strict=True))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), ["doc_id"], mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def _op5_sql() -> str:
    names = MIX_LEVELS

    def weight(c: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in MIX_WEIGHTS.get(c, {}).items())
        return f"(CASE coalesce({c}, '') {cases} ELSE 1.0::DOUBLE END)" if cases else "1.0::DOUBLE"

    steps = []
    for i, c in enumerate(names):
        cols, family = ", ".join(names[: i + 1]), ", ".join(names[:i])
        part = f"PARTITION BY {family}" if family else ""
        up = f"JOIN f{i - 1} u ON " + " AND ".join(f"g.{x} IS NOT DISTINCT FROM u.{x}" for x in names[:i]) if i else ""
        budget = "u.share" if i else f"(SELECT {MIX_SHARE}::DOUBLE * sum(tokens)::DOUBLE FROM leaves)"
        steps.append(f"""n{i} AS (SELECT {', '.join(f'g.{x}' for x in names[: i + 1])}, g.capacity, g.weight, {budget} AS budget, g.capacity / g.weight AS ratio
  FROM (SELECT {cols}, sum(capacity) AS capacity, any_value({weight(c)}) AS weight FROM leaves GROUP BY {cols}) g {up}),
l{i} AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({part} ORDER BY ratio, {cols} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({part} ORDER BY ratio, {cols} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n{i}),
f{i} AS (SELECT {cols}, least(capacity, CASE WHEN ratio > level THEN weight * max(CASE WHEN ratio > level THEN level END) OVER ({part}) ELSE capacity END) AS share FROM l{i})""")
    every = ", ".join(names)
    same = " AND ".join(f"d.{x} IS NOT DISTINCT FROM s.{x}" for x in names)
    return rf"""
WITH docs AS (SELECT doc_id, 'd' || regexp_extract(coalesce(source, ''), '([0-9]?)$', 1) AS domain, lang, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
leaves AS (SELECT {every}, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {MIX_EPOCHS})::DOUBLE AS capacity FROM docs GROUP BY {every}),
{', '.join(steps)},
spread AS (SELECT d.*, e.epoch::INTEGER AS epoch, md5(concat_ws('|', '{MIX_SEED}', e.epoch, coalesce(doc_id::VARCHAR, ''))) AS place FROM docs d, range(1, {MIX_EPOCHS + 1}) e(epoch)),
ordered AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {every} ORDER BY epoch, place, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tokens_before FROM spread)
SELECT d.doc_id, d.domain, d.lang, d.source, d.epoch, d.tokens, d.tokens_before FROM ordered d JOIN f{len(names) - 1} s ON {same} WHERE d.tokens_before < s.share
"""


def op6_backoff_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = backoff_lm.score(docs, ["doc_id"], ~held_out("doc_id", 1))
    return scored.select("doc_id", held_out("doc_id", 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path(), most=2048, end_id=0)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_classifier.fit(docs, table(spark, folder, "labels"))
    scored = quality_classifier.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), URL_RULES, ["page_id"])


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, folder, "documents"), ["doc_id"]).drop("dup_line_chars")


def _op10_sql() -> str:
    rules = quality_rules.Rules()
    lengths = sorted({rules.repeat_window, *rules.ngram_chars_pct})
    part = ", ".join(f"CASE WHEN lead(w, {n - 1}) OVER d IS NOT NULL THEN concat_ws(' ', w, {', '.join(f'lead(w, {i}) OVER d' for i in range(1, n))}) END AS g{n}" for n in lengths)
    flags = ", ".join(f"g{n} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY pos) > 1 AS later{n}" for n in lengths)
    n = rules.repeat_window
    flags += f", g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 AS every"
    cover = ", ".join(f"bool_or(later{n}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS in{n}" for n in lengths)
    cover += f", bool_or(every) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS repeat"
    sums = ", ".join(f"coalesce(sum(length(w)) FILTER (WHERE in{n}), 0) AS c{n}" for n in rules.ngram_chars_pct)
    limits = " AND ".join(f"100 * coalesce(c{n}, 0) <= {pct} * coalesce(word_chars, 0)" for n, pct in rules.ngram_chars_pct.items())
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM texts) s),
grams AS (SELECT doc_id, pos, w, {part} FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
flags AS (SELECT doc_id, pos, w, {flags} FROM grams),
inside AS (SELECT doc_id, w, {cover} FROM flags),
words AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE repeat) AS n_repeat_words, {sums} FROM inside GROUP BY doc_id),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k
          FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM texts) s) t
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS dup_chars FROM lines WHERE k > 1 GROUP BY doc_id),
base AS (
  SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_words, 0) < {rules.min_words} OR 100 * coalesce(n_repeat_words, 0) > {rules.repeat_words_pct} * coalesce(n_words, 0) AS base_failed,
         100 * coalesce(dup_chars, 0) <= {rules.line_chars_pct} * coalesce(word_chars, 0) AND {limits} AS fine
  FROM texts t LEFT JOIN words USING (doc_id) LEFT JOIN dups USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM base
"""


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe_dp.encode(table(spark, folder, "documents"), tokenizer_path(), ["doc_id"], decoded=True)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP12_SQL = r"""
WITH docs AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words LEFT JOIN marks USING (doc_id)
), counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT i, chr((65 + i)::INTEGER) AS c FROM range(5) r(i)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS filters
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT filter_order, s.step::INTEGER AS step, (1 << filters[s.step]::INTEGER)::BIGINT AS bit,
         coalesce(list_sum([(1 << x::INTEGER)::BIGINT FOR x IN filters[1:s.step - 1]]), 0)::BIGINT AS before
  FROM orders, range(1, 6) s(step)
), found AS (
  SELECT part, filter_order, step, any_value(bit) AS bit,
    coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & before) > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM found
"""


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_hnsw": op3_hnsw,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_backoff_lm": op6_backoff_lm,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
    "op11_bpe": op11_bpe,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling": op13_spelling,
}
ORACLE = {"op2_line_dedup": OP2_SQL, "op5_mixing": _op5_sql(), "op10_quality_rules": _op10_sql(), "op12_filter_audit": OP12_SQL}
