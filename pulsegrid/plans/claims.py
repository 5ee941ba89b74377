"""Queries over claims about unreleased models: identities, validation, origins, cards, announcements, expected dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import lexicons as lex
from pulsegrid.functions import text
from pulsegrid.operators import canon, rumors
from pulsegrid.plans.texts import MENTIONS_SQL, mentions
from pulsegrid.plans.views import pick, read
from pulsegrid.shared import cut

PLATFORMS = ["twitter", "bluesky", "web", "github", "reddit"]
LABELS = ["Opus 5.5", "Mythos/Fable 5", "GPT-6 Sol", "GPT-6", "gpt 5.6", "Gemini 4 Pro", "Flash 5 or Pro 5", "Grok 6", "DeepSeek V5", "v7", "7", "Badoo", "Claude Sonnet 5", "o3", None, "GPT-6,5 (Sol)"]
FAMILIES = ["claude", "claude", "chatgpt", "chatgpt", "chatgpt", "gemini", "gemini", "grok", "claude", "grok", "chatgpt", "gemini", "claude", "chatgpt", "claude", "chatgpt"]
CODENAMES = [None, "Sol", "Honeycomb", None, "Sol, Terra", "Orionmist aka Kiwi", "", None]
MODES = [None, "report", "observed_signal", "speculation", "inference", "report"]
EVIDENCE = [None, "artifact", "none", "named_source"]
DOMAINS = ["https://www.theverge.com/", "https://blog.google.com/", "https://example.net/", "https://polymarket.com/"]
TEMPLATES = ["Leaked: {} is in testing", "I think {} should be interesting. More soon", "If {} ships next week we win", "{} delayed, pushed back again! Other news", "No name in here", "Spotted a model id\n{} in the arena", "They said it. {} is imminent? Yes"]
ETAS = ["Q3 2026", "q4", "early May", "mid-june", "week of June 3rd", "by Sept 30, 2027", "next week", "as early as next week", "this week", "in february", "next month", "this month", "July 4", "~new target is soon", "", None]


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims from the first line items of orders."""
    li = read(spark, folder, "lineitem").where("l_linenumber = 1")
    o, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    say = lambda c: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in c))
    user = F.floor(o / 16)
    label, platform = pick(LABELS, p % len(LABELS)), pick(PLATFORMS, o % 5)
    url = (
        F.when(platform == "twitter", say(["https://x.com/User", user, "/status/", o])).when(platform == "bluesky", say(["https://bsky.app/profile/u", user, "/post/b", o]))
        .when(platform == "web", F.concat(pick(DOMAINS, s % 4), o.cast("string"))).when(platform == "github", say(["https://github.com/a/b/", o])).otherwise(say(["https://www.reddit.com/r/ai/", o]))
    )
    return li.select(
        o.alias("id"), F.when(o % 11 == 0, "mistral").otherwise(pick(FAMILIES, p % len(LABELS))).alias("family"), label.alias("label"), pick(CODENAMES, s % len(CODENAMES)).alias("codename"), platform.alias("platform"), url.alias("url"),
        F.when(o % 97 == 0, "@Apples_Jimmy").when(o % 3 == 0, say(["@User", user])).alias("handle"), F.when(o % 6 == 0, (o - 1).cast("string")).alias("quoted"),
        F.replace(pick(TEMPLATES, o % len(TEMPLATES)), F.lit("{}"), F.coalesce(label, F.lit("it"))).alias("text"), pick(MODES, (p + o) % len(MODES)).alias("claim_mode"), pick(EVIDENCE, s % 4).alias("evidence_kind"),
        F.when(o % 10 != 0, (o * 7 % 100) / 100.0).alias("confidence"), (o % 13 != 0).alias("is_rumor"), (o % 17 != 0).alias("is_unreleased"), (o % 3 == 0).alias("verified"), (s * 37 % 20000).alias("followers"),
        pick(rumors.PRECEDENCE, p % len(rumors.PRECEDENCE)).alias("claim_type"), F.col("l_shipdate").cast("timestamp").alias("posted_at"), pick(ETAS, o % len(ETAS)).alias("eta_text"),
    )


def listed(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def picked(values: list, place: str) -> str:
    return f"({listed(values)})[({place}) + 1]"


_LABEL = picked(LABELS, f"l_partkey % {len(LABELS)}")
_PLATFORM = picked(PLATFORMS, "l_orderkey % 5")
_USER = "(l_orderkey // 16)"
CLAIMS_SQL = f"""claims AS (SELECT l_orderkey AS id, CASE WHEN l_orderkey % 11 = 0 THEN 'mistral' ELSE {picked(FAMILIES, f'l_partkey % {len(LABELS)}')} END AS family, {_LABEL} AS label, {picked(CODENAMES, f'l_suppkey % {len(CODENAMES)}')} AS codename,
  {_PLATFORM} AS platform, CASE {_PLATFORM} WHEN 'twitter' THEN 'https://x.com/User' || {_USER} || '/status/' || l_orderkey WHEN 'bluesky' THEN 'https://bsky.app/profile/u' || {_USER} || '/post/b' || l_orderkey
    WHEN 'web' THEN {picked(DOMAINS, 'l_suppkey % 4')} || l_orderkey WHEN 'github' THEN 'https://github.com/a/b/' || l_orderkey ELSE 'https://www.reddit.com/r/ai/' || l_orderkey END AS url,
  CASE WHEN l_orderkey % 97 = 0 THEN '@Apples_Jimmy' WHEN l_orderkey % 3 = 0 THEN '@User' || {_USER} END AS handle, CASE WHEN l_orderkey % 6 = 0 THEN (l_orderkey - 1)::VARCHAR END AS quoted,
  replace({picked(TEMPLATES, f'l_orderkey % {len(TEMPLATES)}')}, '{{}}', coalesce({_LABEL}, 'it')) AS text, {picked(MODES, f'(l_partkey + l_orderkey) % {len(MODES)}')} AS claim_mode, {picked(EVIDENCE, 'l_suppkey % 4')} AS evidence_kind,
  CASE WHEN l_orderkey % 10 <> 0 THEN (l_orderkey * 7 % 100) / 100.0::DOUBLE END AS confidence, l_orderkey % 13 <> 0 AS is_rumor, l_orderkey % 17 <> 0 AS is_unreleased, l_orderkey % 3 = 0 AS verified, l_suppkey * 37 % 20000 AS followers,
  {picked(rumors.PRECEDENCE, f'l_partkey % {len(rumors.PRECEDENCE)}')} AS claim_type, l_shipdate AS posted_at, {picked(ETAS, f'l_orderkey % {len(ETAS)}')} AS eta_text FROM lineitem WHERE l_linenumber = 1)"""


def squash_sql(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"


def split_sql(x: str) -> str:
    parts = rf"list_filter(list_transform(string_split_regex(coalesce(trim({x}), ''), '(?i)\s*(?:/|\bor\b|\baka\b|,|&)\s*'), lambda p: trim(p)), lambda p: p <> '')"
    return rf"""(SELECT CASE WHEN raw = '' THEN []::VARCHAR[] WHEN len(ps) <= 1 THEN [raw] WHEN regexp_matches(ps[-1], '\s\d+(?:\.\d+)?$') THEN list_transform(ps, lambda p: CASE WHEN regexp_matches(p, '\d') THEN p ELSE p || ' ' || regexp_extract(ps[-1], '\s(\d+(?:\.\d+)?)$', 1) END) ELSE ps END
      FROM (SELECT coalesce(trim({x}), '') AS raw, {parts} AS ps))"""


_VERSIONS = ", ".join(f"('{f}', '{k}', '{lb}', {repr(c) if c else 'NULL::VARCHAR'}, {listed(a)}, {r})" for f, k, lb, c, a, r, _ in lex.VERSIONS)
KNOWN_SQL = f"""versions AS (SELECT * FROM (VALUES {_VERSIONS}) v(family, key, label, codename, aliases, released)),
spellings AS (SELECT family, unnest(aliases) AS alias, key, label, codename FROM versions),
gone AS (SELECT DISTINCT t FROM (SELECT key AS t FROM versions WHERE released UNION ALL SELECT unnest(aliases) FROM versions WHERE released))"""
_GEN = r"(?i)^(?:(?:chatgpt|gpt)[\s-]*)?(?:v\s*)?(\d+(?:[.,]\d+)*)(.*)$"
CANON_SQL = rf"""{CLAIMS_SQL}, {KNOWN_SQL},
names AS (SELECT c.*, list_concat(ls, cs) AS parts, cs FROM (SELECT *, {split_sql('label')} AS ls, {split_sql('codename')} AS cs FROM claims) c),
tried AS (SELECT family, parts, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT DISTINCT family, parts FROM names)),
hits AS (SELECT t.family, t.parts, arg_min(s.key, i) AS key FROM tried t JOIN spellings s ON s.family = t.family AND s.alias = {squash_sql('part')} GROUP BY t.family, t.parts),
hit AS (SELECT h.family, h.parts, h.key, s.label, s.codename FROM hits h JOIN versions s ON s.key = h.key),
numbered AS (SELECT n.*, nullif(trim(label), '') AS lab, nullif(trim(codename), '') AS code, replace(regexp_extract(coalesce(trim(label), ''), '{_GEN}', 1), ',', '.') AS num,
  nullif(trim(regexp_replace(regexp_extract(coalesce(trim(label), ''), '{_GEN}', 2), '^[\s\-–—:·/|,()]+', '')), '') AS suffix FROM names n),
suffixed AS (SELECT *, list_filter(list_transform({split_sql('suffix')}, lambda p: {squash_sql('p')}), lambda p: p <> '') AS sp, list_transform(cs, lambda p: {squash_sql('p')}) AS cp FROM numbered),
generation AS (SELECT *, family = 'chatgpt' AND num <> '' AND (suffix IS NULL OR (code IS NOT NULL AND len(sp) > 0 AND list_has_all(cp, sp))) AS g FROM suffixed),
canon AS (SELECT n.id, n.family, n.label, n.codename, n.text, n.platform, n.url, n.handle, n.quoted, n.claim_mode, n.evidence_kind, n.confidence, n.is_rumor, n.is_unreleased, n.verified, n.followers, n.claim_type, n.posted_at,
  CASE WHEN h.key IS NOT NULL THEN h.key WHEN g THEN 'gpt' || regexp_replace(num, '[^0-9]', '', 'g') WHEN length({squash_sql("coalesce(nullif(n.label, ''), n.codename)")}) >= 2 THEN {squash_sql("coalesce(nullif(n.label, ''), n.codename)")} END AS key,
  CASE WHEN h.key IS NOT NULL THEN h.label WHEN g THEN 'GPT-' || num ELSE lab END AS canon_label, CASE WHEN h.key IS NOT NULL THEN h.codename ELSE code END AS canon_codename FROM generation n LEFT JOIN hit h ON h.family = n.family AND h.parts = n.parts)"""


def qualified(spark: SparkSession, folder: str) -> DataFrame:
    c = claims(spark, folder)
    return c.withColumn("quality", text.source_quality(canon.handle_of(F.col("handle"), F.col("url")), F.col("url"), F.col("platform"), F.col("quoted").isNotNull()))


def canonical_keys(spark: SparkSession, folder: str) -> DataFrame:
    found = canon.canonical(claims(spark, folder), canon.catalogue(spark))
    return found.select("id", "key", "canon_label", "canon_codename", F.concat_ws("|", canon.split_label(F.col("label"))).alias("parts"))


def source_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Of each claim's source what kind it is and by what it's known."""
    tokens = canon.origin_tokens(F.col("platform"), F.col("handle"), F.col("url"), F.col("quoted"))
    return qualified(spark, folder).select("id", "quality", canon.handle_of(F.col("handle"), F.col("url")).alias("account"), F.concat_ws(" ", tokens).alias("tokens"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '')"
_OWN = r"nullif(lower(regexp_replace(trim(coalesce(handle, '')), '^@', '')), '')"
_ACCOUNT = rf"coalesce({_OWN}, nullif(lower(CASE WHEN {_HOST} IN ('x.com', 'twitter.com') THEN regexp_extract(url, '://[^/]*/+([^/]+)/+status(?:/|$)', 1) WHEN {_HOST} = 'bsky.app' THEN regexp_extract(url, '://[^/]*/+profile/+([^/]+)/+post(?:/|$)', 1) END), ''))"
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_under = lambda xs: f"regexp_matches(host, '(^|\\.)({'|'.join(x.replace('.', chr(92) + '.') for x in xs)})$')"
SOURCE_SQL = f"""hosted AS (SELECT *, {_HOST} AS host, {_ACCOUNT} AS account FROM canon),
sourced AS (SELECT *, CASE WHEN account IN {_in(lex.TRACKED_LEAKERS)} THEN 'tracked_leaker' WHEN account IN {_in(lex.ARTIFACT_LEAKERS)} THEN 'artifact_leak' WHEN account IN {_in(lex.SCOOP_HANDLES)} THEN 'press_scoop' WHEN account IN {_in(lex.OFFICIAL_HANDLES)} THEN 'official'
  WHEN {_under(lex.OFFICIAL_DOMAINS)} OR platform = 'official' THEN 'official' WHEN {_under(lex.SCOOP_DOMAINS)} THEN 'press_scoop' WHEN {_under(lex.ARTIFACT_DOMAINS)} OR platform = 'github' THEN 'artifact_leak'
  WHEN {_under(lex.MARKET_DOMAINS)} OR platform = 'prediction_market' THEN 'prediction_market' WHEN quoted IS NOT NULL OR {_under(lex.ECHO_DOMAINS)} OR platform = 'press' THEN 'press_echo' ELSE 'unknown' END AS quality,
  list_filter([platform || ':account:' || account, platform || ':post:' || nullif(CASE WHEN host = 'x.com' THEN regexp_extract(url, '/status/([^/]+)', 1) WHEN host = 'bsky.app' THEN regexp_extract(url, '/post/([^/]+)', 1) END, ''),
    'twitter:post:' || quoted, CASE WHEN platform = 'web' THEN 'web:domain:' || host END], lambda t: t IS NOT NULL) AS t0 FROM hosted),
tokened AS (SELECT * EXCLUDE (t0), CASE WHEN len(t0) = 0 THEN [platform || ':url:' || url] ELSE t0 END AS tokens FROM sourced)"""


def claim_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Why a claim is rejected; null if it's kept."""
    return canon.rejection(qualified(spark, folder), canon.catalogue(spark)).select("id", "rejected")


def spec_sql(x: str) -> str:
    return text.any_of_sql(x, lex.SPECULATION)


_Q = squash_sql("label")
_NAMES = f"list_filter(list_transform(list_concat({split_sql('label')}, {split_sql('codename')}), lambda p: {squash_sql('p')}), lambda p: length(p) >= 2)"
_FITS = " OR ".join(f"(family = '{f}' AND regexp_matches({_Q}, '{p}'))" for f, p in lex.FAMILY_LABELS.items())
_DENY = lambda x: f"({squash_sql(x)} IN {_in([d for d in lex.OTHER_MODELS if len(d) < 4])} OR regexp_matches({squash_sql(x)}, '{'|'.join(d for d in lex.OTHER_MODELS if len(d) >= 4)}'))"
_GONE = lambda x: f"({squash_sql(x)} IN (SELECT t FROM gone)" + "".join(f" OR (starts_with({squash_sql(x)}, '{s}') AND {squash_sql(x)}[{len(s) + 1}:] IN (SELECT t FROM gone))" for s in lex.FAMILY_STEMS) + ")"
_VETTED = f"(quality IN {_in(lex.VETTED)} OR (coalesce(claim_mode, '') = 'observed_signal' AND coalesce(evidence_kind, '') = 'artifact'))"
VALID_SQL = rf"""named AS (SELECT *, {_NAMES} AS nm, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS chunks FROM tokened),
scoped AS (SELECT *, array_to_string(list_filter(chunks, lambda x: len(list_filter(nm, lambda n: contains({squash_sql('x')}, n))) > 0), ' ') AS said FROM named),
judged AS (SELECT *, CASE WHEN NOT is_rumor THEN 'no rumour' WHEN NOT is_unreleased THEN 'said to be released' WHEN family NOT IN {_in(lex.FAMILY_LABELS)} THEN 'unknown family'
  WHEN claim_mode = 'speculation' OR (claim_mode IS NULL AND NOT {_VETTED} AND {spec_sql("(CASE WHEN said = '' THEN text ELSE said END)")}) THEN 'speculation'
  WHEN claim_mode = 'inference' AND coalesce(evidence_kind, 'none') = 'none' THEN 'inference without evidence' WHEN confidence < {canon.LEAST_CONFIDENCE} THEN 'low confidence'
  WHEN length({_Q}) >= 2 AND NOT contains({squash_sql('text')}, {_Q}) THEN 'label not in text'
  WHEN {_DENY('label')} OR {_DENY('codename')} OR (nullif(trim(label), '') IS NOT NULL AND NOT (regexp_matches(lower(trim(label)), '^v?\d+(\.\d+)?$') OR {_FITS} OR EXISTS (SELECT 1 FROM spellings s WHERE s.family = scoped.family AND contains({squash_sql('scoped.label')}, s.alias)))) THEN 'foreign model'
  WHEN key IS NULL THEN 'no identity' WHEN key IN (SELECT t FROM gone) OR {_GONE('canon_label')} OR {_GONE('canon_codename')} THEN 'released' END AS rejected FROM scoped)"""


def valid(spark: SparkSession, folder: str) -> DataFrame:
    """Claims that hold; judged claims are written first, as a filter on the verdict would be pushed below the steps that lead to it."""
    return cut(canon.rejection(qualified(spark, folder), canon.catalogue(spark)), "judged").where("rejected is null")


def origin_components(spark: SparkSession, folder: str) -> DataFrame:
    """How many independent origins each model of a family has."""
    rows = valid(spark, folder).withColumn("sources", canon.origin_tokens(F.col("platform"), F.col("handle"), F.col("url"), F.col("quoted")))
    found = canon.with_component(rows, ["family", "key"], F.col("sources"), "origin")
    return found.groupBy("family", "key").agg(F.count(F.lit(1)).alias("n_claims"), F.count_distinct("origin").alias("n_origins"))


def rumor_cards(spark: SparkSession, folder: str) -> DataFrame:
    return canon.cards(valid(spark, folder)).drop("card").withColumn("vetted", F.col("vetted").cast("boolean"))


def components_sql(rows: str, scope: str, tokens: str, name: str) -> str:
    """Tables up to ``name`` (scope, n, root): the components that rows' tokens form within a scope."""
    return f"""{name}_t AS (SELECT DISTINCT {scope} AS scope, ({tokens})[1] AS a, unnest({tokens}) AS b FROM {rows}), {name}_b AS (SELECT scope, a, b FROM {name}_t UNION SELECT scope, b, a FROM {name}_t),
{name}_r AS (SELECT scope, a AS n, a AS m FROM {name}_b UNION SELECT r.scope, r.n, b.b FROM {name}_r r JOIN {name}_b b ON b.scope = r.scope AND b.a = r.m),
{name} AS (SELECT scope, n, min(m) AS root FROM {name}_r GROUP BY scope, n)"""


_OWN_NAME = squash_sql("canon_label")
_TOKENS = f"list_distinct(list_concat(list_filter([key, CASE WHEN length({_OWN_NAME}) >= 2 THEN {_OWN_NAME} END], lambda t: t IS NOT NULL), list_filter(list_transform({split_sql('canon_codename')}, lambda p: {squash_sql('p')}), lambda p: length(p) >= 2)))"
_RANKED = "CASE quality " + " ".join(f"WHEN '{k}' THEN {10 * v}" for k, v in lex.QUALITY_RANK.items()) + " END"
_KINDS = "CASE coalesce(evidence_kind, '') " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lex.EVIDENCE_RANK.items()) + " ELSE 0 END"
CARDS_SQL = f"""ok AS (SELECT *, {_TOKENS} AS names FROM judged WHERE rejected IS NULL), {components_sql('ok', 'family', 'names', 'card')},
carded AS (SELECT ok.*, family || '|' || c.root AS card, greatest({_RANKED}, {_KINDS}) AS rank FROM ok JOIN card c ON c.scope = ok.family AND c.n = ok.names[1]), {components_sql('carded', 'card', 'tokens', 'origin')},
ranked AS (SELECT c.*, o.root AS origin, {_VETTED} AS vetted, greatest(rank, CASE WHEN quality = 'tracked_leaker' THEN 0 WHEN verified AND followers >= 10000 THEN 8 WHEN account IS NOT NULL THEN 4 ELSE 0 END) AS sort FROM carded c JOIN origin o ON o.scope = c.card AND o.n = c.tokens[1]),
made AS (SELECT family, card, count(DISTINCT origin) AS mention_count, count(DISTINCT platform) AS platform_count, bool_or(vetted) AS vetted, arg_max(claim_type, (rank, sort, posted_at, id, claim_type)) AS claim_type, max(rank) AS evidence, min(posted_at) AS first_seen_at, max(posted_at) AS last_seen_at,
  arg_min(struct_pack(l := canon_label, c := canon_codename), (-(CASE WHEN canon_label IS NOT NULL THEN 20 ELSE 0 END) - (CASE WHEN canon_codename IS NOT NULL THEN 10 ELSE 0 END), -epoch(posted_at), id, coalesce(canon_label, ''), coalesce(canon_codename, ''))) AS nm FROM ranked GROUP BY family, card)"""


def released_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that stand for a model id; ids are made of labels."""
    ids = claims(spark, folder).select(F.concat(F.when(F.col("id") % 3 == 0, F.lit("models/")).otherwise(""), F.lower(F.replace(F.coalesce("label", F.lit("gpt-4o")), F.lit(" "), F.lit("-"))), F.when(F.col("id") % 4 == 1, F.lit("-20251001")).when(F.col("id") % 4 == 2, F.lit("-preview")).otherwise("")).alias("model_id")).distinct()
    return ids.select("model_id", F.concat_ws(",", F.array_sort(canon.id_tokens(F.col("model_id")))).alias("tokens"))


def release_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Versions that texts announce, from example texts and all documents."""
    found = mentions(spark, folder).select("id", F.concat_ws(",", canon.announced_keys(spark, F.col("text"))).alias("keys"))
    return found.where("keys <> ''")


def _announced_sql() -> str:
    parts = [f"CASE WHEN regexp_matches({squash_sql('text')}, '{'|'.join(safe)}') THEN ['{key}'] ELSE [] END" for _, key, _, _, _, _, safe in lex.VERSIONS if safe]
    for family, pattern in lex.ANNOUNCED:
        spelled = " ".join(f"WHEN '{a}' THEN '{k}'" for f, k, _, _, aliases, _, _ in lex.VERSIONS if f == family for a in aliases)
        parts.append(f"list_transform(regexp_extract_all(text, '(?i){pattern}'), lambda m: CASE {squash_sql('m')} {spelled} ELSE {squash_sql('m')} END)")
    return f"list_sort(list_distinct(flatten([{', '.join(parts)}])))"


def claim_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """What claims say, by their wording in the sentences that name the model, and whether they only speculate."""
    said = canon.scoped_text(F.col("text"), F.col("label_parts"), F.col("code_parts"))
    return canon.canonical(claims(spark, folder), canon.catalogue(spark)).select("id", "claim_mode", "text", said.alias("said")).select("id", canon.claim_kind(F.col("said")).alias("kind"), canon.is_speculation(F.col("claim_mode"), F.col("text")).alias("speculative"))


def eta_said(spark: SparkSession, folder: str) -> DataFrame:
    """When claims expect their model, in words as exact as they allow, from the day they were made."""
    return rumors.with_eta(claims(spark, folder).select("id", "eta_text", "posted_at"), "eta_text", "posted_at")


_DAY = lambda x: f"strftime({x}, '%b ') || day({x}) || ', ' || year({x})"
_MONTH = lambda x: f"strftime({x}, '%B %Y')"
_M = "(" + "|".join(f"{m}|{m[:3]}" for m in rumors.MONTHS) + ")"
_NUMBER = lambda x: "CASE " + " ".join(f"WHEN starts_with({x}, '{m[:3]}') THEN {i + 1}" for i, m in enumerate(rumors.MONTHS)) + " END"
_YEAR = lambda m, y: f"coalesce(nullif({y}, '')::INTEGER, CASE WHEN {m} < month(r) THEN year(r) + 1 ELSE year(r) END)"
_FULL = rf"\b{_M}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s*(\d{{4}}))?"
ETA_SQL = rf"""WITH {CLAIMS_SQL}, e AS (SELECT id, eta_text, posted_at, posted_at::DATE AS r, trim(regexp_replace(eta_text, '\s+', ' ', 'g')) AS raw, lower(trim(regexp_replace(eta_text, '\s+', ' ', 'g'))) AS s FROM claims),
p AS (SELECT *, regexp_extract(s, '{_FULL}', 1) AS dm, regexp_extract(s, '{_FULL}', 2) AS dd, regexp_extract(s, '{_FULL}', 3) AS dy, regexp_extract(s, '\b(early|mid|late)[-\s]+{_M}\b', 1) AS ww, regexp_extract(s, '\b(early|mid|late)[-\s]+{_M}\b', 2) AS wm,
  regexp_extract(s, '\b(in|into|during|through)\s+{_M}\b', 2) AS om, regexp_extract(s, '\bq([1-4])(?:\s*(\d{{4}}))?\b', 1) AS q, regexp_extract(s, '\bq([1-4])(?:\s*(\d{{4}}))?\b', 2) AS qy FROM e),
m AS (SELECT *, {_NUMBER('dm')} AS dn, {_NUMBER('wm')} AS wn, {_NUMBER('om')} AS onn FROM p),
x AS (SELECT *, CASE WHEN dm <> '' THEN make_date({_YEAR('dn', 'dy')}, dn, 1) + (dd::INTEGER - 1) END AS d FROM m)
SELECT id, eta_text, posted_at, CASE WHEN raw IS NULL OR raw = '' THEN NULL WHEN contains(s, 'week of') AND d IS NOT NULL THEN 'Week of ' || {_DAY('d')} WHEN regexp_matches(s, '\bby\b') AND d IS NOT NULL THEN 'By ' || {_DAY('d')}
  WHEN ww <> '' THEN upper(ww[1]) || ww[2:] || '-' || {_MONTH(f"make_date({_YEAR('wn', chr(39) * 2)}, wn, 1)")} WHEN om <> '' THEN {_MONTH(f"make_date({_YEAR('onn', chr(39) * 2)}, onn, 1)")} WHEN q <> '' THEN 'Q' || q || ' ' || coalesce(nullif(qy, ''), year(r)::VARCHAR)
  WHEN contains(s, 'next week') THEN CASE WHEN contains(s, 'as early as') THEN 'As early as the week of ' ELSE 'Week of ' END || {_DAY("date_trunc('week', r + 7)")} WHEN contains(s, 'this week') THEN 'Week of ' || {_DAY("date_trunc('week', r)")}
  WHEN contains(s, 'next month') THEN {_MONTH("(date_trunc('month', r) + INTERVAL 1 MONTH)")} WHEN contains(s, 'this month') THEN {_MONTH('r')} WHEN d IS NOT NULL THEN {_DAY('d')}
  ELSE (SELECT CASE WHEN t = '' THEN raw ELSE upper(t[1]) || t[2:] END FROM (SELECT trim(regexp_replace(regexp_replace(regexp_replace(raw, '^~+', ''), '(?i)^(?:new\s+)?target(?:\s+is)?\s+', ''), '(?i)^expected\s+', '')) AS t)) END AS eta FROM x"""
_KIND = "CASE " + " ".join(f"WHEN {text.has_sql('s', p)} THEN '{k}'" for k, p in lex.CLAIM_KINDS) + " END"
_C = f"WITH RECURSIVE {CANON_SQL}, {SOURCE_SQL}, {VALID_SQL} "
QUERIES = {
    "canonical_keys": canonical_keys,
    "source_identity": source_identity,
    "claim_validation": claim_validation,
    "origin_components": origin_components,
    "rumor_cards": rumor_cards,
    "released_tokens": released_tokens,
    "release_keys": release_keys,
    "claim_kinds": claim_kinds,
    "eta_said": eta_said,
}
_ID = "CASE WHEN id % 3 = 0 THEN 'models/' ELSE '' END || lower(replace(coalesce(label, 'gpt-4o'), ' ', '-')) || CASE id % 4 WHEN 1 THEN '-20251001' WHEN 2 THEN '-preview' ELSE '' END"
_FULL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(model_id, '^models/', ''), '[-@][0-9]{6,8}$', ''), '-(latest|preview|exp|experimental|thinking)$', ''), '[^a-z0-9]', '', 'g')"
_STEMMED = ", ".join(f"CASE WHEN starts_with(s, '{x}') AND length(s) > {len(x) + 2} THEN s[{len(x) + 1}:] END" for x in ("claude", "gpt", "gemini", "grok"))
ORACLE = {
    "eta_said": ETA_SQL,
    "canonical_keys": f"WITH {CANON_SQL} SELECT id, key, canon_label, canon_codename, array_to_string({split_sql('label')}, '|') AS parts FROM canon",
    "source_identity": f"WITH {CANON_SQL}, {SOURCE_SQL} SELECT id, quality, account, array_to_string(tokens, ' ') AS tokens FROM tokened",
    "claim_validation": _C + "SELECT id, rejected FROM judged",
    "origin_components": _C + f", k AS (SELECT *, family || ':' || key AS fk FROM judged WHERE rejected IS NULL), {components_sql('k', 'fk', 'tokens', 'o')} SELECT family, key, count(*) AS n_claims, count(DISTINCT root) AS n_origins FROM k JOIN o ON o.scope = k.fk AND o.n = k.tokens[1] GROUP BY family, key",
    "rumor_cards": _C + f", {CARDS_SQL} SELECT family, nm.l AS label, nm.c AS codename, claim_type, mention_count, platform_count, vetted, vetted OR mention_count >= 3 OR (mention_count >= 2 AND platform_count >= 2) AS strong, evidence * 10000 + platform_count * 100 + mention_count AS strength, first_seen_at, last_seen_at FROM made",
    "released_tokens": f"WITH {CLAIMS_SQL}, ids AS (SELECT DISTINCT {_ID} AS model_id FROM claims), f AS (SELECT model_id, {_FULL} AS s FROM ids) SELECT model_id, array_to_string(list_sort(list_filter([CASE WHEN length(s) >= 3 THEN s END, {_STEMMED}], lambda t: t IS NOT NULL)), ',') AS tokens FROM f",
    "release_keys": f"WITH {MENTIONS_SQL} SELECT * FROM (SELECT id, array_to_string({_announced_sql()}, ',') AS keys FROM mentions) WHERE keys <> ''",
    "claim_kinds": _C + f"SELECT id, {_KIND} AS kind, CASE WHEN claim_mode IS NOT NULL THEN claim_mode = 'speculation' ELSE {spec_sql('trim(text)')} END AS speculative FROM (SELECT *, CASE WHEN said = '' THEN text ELSE said END AS s FROM scoped)",
}
