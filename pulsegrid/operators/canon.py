"""Identities of rumoured models: compound labels, canonical keys, released and foreign names, sources' origins, validation of claims.

The catalogue of known versions is a small table that a caller may replace; it is joined as one row for each family, so a claim looks
its spellings up in a map and nothing is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import lexicons as lex
from pulsegrid.functions import text
from pulsegrid.operators.graph import connected_components
from pulsegrid.shared import cut

SEPARATOR = r"(?i)\s*(?:/|\bor\b|\baka\b|,|&)\s*"
GENERATION = r"(?i)^(?:(?:chatgpt|gpt)[\s-]*)?(?:v\s*)?(\d+(?:[.,]\d+)*)(.*)$"
STRIP = r"^[\s\-–—:·/|,()]+"
LEAST_CONFIDENCE = 0.55


def cleaned(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def squashed(c: Column) -> Column:
    return text.squash(F.coalesce(c, F.lit("")))


def version_key(label: Column, codename: Column) -> Column:
    """A label's letters and digits, or the codename's; null if they are fewer than two."""
    key = squashed(F.coalesce(F.nullif(label, F.lit("")), codename))
    return F.when(F.length(key) >= 2, key)


def label_parts(label: Column) -> Column:
    """The parts of a compound label as they are written."""
    return F.filter(F.transform(F.split(F.coalesce(F.trim(label), F.lit("")), lex.java(SEPARATOR)), F.trim), lambda p: p != "")


def numbered_parts(label: Column, parts: Column) -> Column:
    """A number after the last of several parts holds for those without digits too."""
    last = F.regexp_extract(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"\s(\d+(?:\.\d+)?)$", 1)
    several = F.transform(parts, lambda p: F.when((last == "") | p.rlike(r"\d"), p).otherwise(F.concat(p, F.lit(" "), last)))
    return F.when(F.size(parts) > 1, several).when(F.trim(label) != "", F.array(F.trim(label))).otherwise(F.array().cast("array<string>"))


def split_label(label: Column) -> Column:
    """The versions that a compound label names."""
    return numbered_parts(label, label_parts(label))


def catalogue(spark: SparkSession, versions: list[tuple] = lex.VERSIONS) -> DataFrame:
    """One row for each family: (family, spellings: map of spelling to identity, own: its spellings, released: those of all families)."""
    rows = spark.createDataFrame(versions, "family string, key string, label string, codename string, aliases array<string>, released boolean, announced array<string>")
    each = rows.select("family", F.explode("aliases").alias("alias"), F.struct("key", "label", "codename").alias("to"))
    own = each.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("alias", "to"))).alias("spellings"), F.array_sort(F.collect_list("alias")).alias("own"))
    out = rows.where("released").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("key"), "aliases"))))).alias("released"))
    return own.withColumn("one", F.lit(1)).join(out.withColumn("one", F.lit(1)), "one").drop("one")


def canonical(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Add key, canon_label, canon_codename, own, released, label_parts and code_parts to claims (family, label, codename).

    The first part of label or codename that is a known spelling decides; else a numbered generation, whose suffix may only repeat
    codenames; else the squashed label or codename itself. Each step is a projection of its own, so that none is computed twice.
    """
    given = F.coalesce(F.trim("label"), F.lit(""))
    rows = claims.join(known, "family", "left").select("*", label_parts(F.col("label")).alias("_l"), label_parts(F.col("codename")).alias("_c"), cleaned(F.col("label")).alias("_label"), cleaned(F.col("codename")).alias("_code"),
        F.replace(F.regexp_extract(given, GENERATION, 1), F.lit(","), F.lit(".")).alias("_number"), cleaned(F.regexp_replace(F.regexp_extract(given, GENERATION, 2), STRIP, "")).alias("_suffix"))
    rows = rows.select("*", numbered_parts(F.col("label"), F.col("_l")).alias("label_parts"), numbered_parts(F.col("codename"), F.col("_c")).alias("code_parts"), label_parts(F.col("_suffix")).alias("_s"))
    full = lambda parts: F.filter(F.transform(parts, text.squash), lambda p: p != "")
    hits = F.filter(F.transform(F.concat("label_parts", "code_parts"), lambda p: F.try_element_at("spellings", text.squash(p))), lambda x: x.isNotNull())
    rows = rows.select("*", F.try_element_at(hits, F.lit(1)).alias("_hit"), full(numbered_parts(F.col("_suffix"), F.col("_s"))).alias("_said"), full(F.col("code_parts")).alias("_known"))
    repeats = F.col("_suffix").isNull() | (F.col("_code").isNotNull() & (F.size("_said") > 0) & (F.size(F.array_except("_said", "_known")) == 0))
    rows = rows.withColumn("_numbered", (F.col("family") == "chatgpt") & (F.col("_number") != "") & repeats)
    choose = lambda a, b, c: F.when(F.col("_hit").isNotNull(), a).when(F.col("_numbered"), b).otherwise(c)
    hit, none = F.col("_hit"), F.array().cast("array<string>")
    return rows.select(
        *claims.columns,
        choose(hit["key"], F.concat(F.lit("gpt"), F.regexp_replace("_number", "[^0-9]", "")), version_key(F.col("label"), F.col("codename"))).alias("key"),
        choose(hit["label"], F.concat(F.lit("GPT-"), "_number"), F.col("_label")).alias("canon_label"), choose(hit["codename"], F.col("_code"), F.col("_code")).alias("canon_codename"),
        F.coalesce("own", none).alias("own"), F.coalesce("released", none).alias("released"), "label_parts", "code_parts",
    )


def is_foreign(family: Column, label: Column, codename: Column, own: Column) -> Column:
    """Whether a claim names another vendor's model, or a label that doesn't look like its family."""
    def denied(c: Column) -> Column:
        q = squashed(c)
        return q.isin([d for d in lex.OTHER_MODELS if len(d) < 4]) | q.rlike("|".join(d for d in lex.OTHER_MODELS if len(d) >= 4))

    q = squashed(label)
    fits = F.lower(F.trim(label)).rlike(r"^v?\d+(\.\d+)?$") | F.exists(own, lambda a: F.contains(q, a))
    for name, pattern in lex.FAMILY_LABELS.items():
        fits = fits | ((family == name) & q.rlike(pattern))
    return denied(label) | denied(codename) | F.coalesce(cleaned(label).isNotNull() & ~fits, F.lit(False))


def is_released(key: Column, label: Column, codename: Column, released: Column) -> Column:
    """Whether the key, or label or codename with or without a family's stem, is that of a released version."""
    found = F.coalesce(F.array_contains(released, key), F.lit(False))
    for c in (label, codename):
        q = squashed(c)
        found = found | F.array_contains(released, q)
        for stem in lex.FAMILY_STEMS:
            found = found | (q.startswith(stem) & F.array_contains(released, F.substring(q, F.lit(len(stem) + 1), F.length(q))))
    return found


def scoped_text(body: Column, label_parts: Column, code_parts: Column) -> Column:
    """The sentences that speak of the claim's model; the whole text if none does."""
    names = F.filter(F.transform(F.concat(label_parts, code_parts), text.squash), lambda x: F.length(x) >= 2)
    chunks = F.filter(F.transform(F.split(F.regexp_replace(body, r"([.!?])\s+", "$1\n"), r"\n+"), F.trim), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(F.filter(chunks, lambda x: F.exists(names, lambda n: F.contains(text.squash(x), n))), " "), F.lit("")), body)


def is_speculation(mode: Column, body: Column) -> Column:
    """By the claim's mode where it has one, else by its wording."""
    return F.when(mode.isNotNull(), mode == "speculation").otherwise(text.any_of(F.trim(F.coalesce(body, F.lit(""))), lex.SPECULATION))


def is_vetted(quality: Column, mode: Column, evidence: Column) -> Column:
    return quality.isin(lex.VETTED) | F.coalesce((mode == "observed_signal") & (evidence == "artifact"), F.lit(False))


def rejection(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``rejected``, the first rule that a claim breaks or null, to claims with text, quality, claim_mode, evidence_kind, confidence, is_rumor, is_unreleased."""
    rows = canonical(claims, known)
    rows = rows.select("*", scoped_text(F.col("text"), F.col("label_parts"), F.col("code_parts")).alias("_scoped"), squashed(F.col("label")).alias("_name"), text.squash(F.col("text")).alias("_text"))
    label, code, mode, name = F.col("label"), F.col("codename"), F.col("claim_mode"), F.col("_name")
    guess = mode.isNull() & ~is_vetted(F.col("quality"), mode, F.col("evidence_kind")) & text.any_of(F.col("_scoped"), lex.SPECULATION)
    why = (
        F.when(~F.coalesce("is_rumor", F.lit(False)), "no rumour")
        .when(~F.coalesce("is_unreleased", F.lit(False)), "said to be released")
        .when(~F.col("family").isin(list(lex.FAMILY_LABELS)), "unknown family")
        .when((mode == "speculation") | guess, "speculation")
        .when((mode == "inference") & (F.coalesce("evidence_kind", F.lit("none")) == "none"), "inference without evidence")
        .when(F.col("confidence") < LEAST_CONFIDENCE, "low confidence")
        .when((F.length(name) >= 2) & ~F.contains(F.col("_text"), name), "label not in text")
        .when(is_foreign(F.col("family"), label, code, F.col("own")), "foreign model")
        .when(F.col("key").isNull(), "no identity")
        .when(is_released(F.col("key"), F.col("canon_label"), F.col("canon_codename"), F.col("released")), "released")
    )
    return rows.withColumn("rejected", why).drop("own", "released", "label_parts", "code_parts", "_scoped", "_name", "_text")


def claim_kind(body: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(lex.CLAIM_KINDS):
        out = F.when(text.has(body, pattern), kind).otherwise(out)
    return out


def looked_up(labels: Column, spellings: Column) -> Column:
    """Squashed labels, or what a map has for them."""
    return F.transform(labels, lambda m: F.coalesce(F.try_element_at(spellings, text.squash(m)), text.squash(m)))


def announced_keys(spark: SparkSession, body: Column, versions: list[tuple] = lex.VERSIONS) -> Column:
    """Keys of the versions that an announcement names: safe spellings anywhere, and labels with numbers of each family."""
    squash, found = text.squash(body), []
    for _, key, _, _, _, _, safe in versions:
        if safe:
            found.append(F.when(squash.rlike("|".join(safe)), F.array(F.lit(key))))
    known = {(f, a): key for f, key, _, _, aliases, _, _ in versions for a in aliases}
    for family, pattern in lex.ANNOUNCED:
        spelled = F.create_map(*(F.lit(x) for (f, a), key in known.items() if f == family for x in (a, key)))
        found.append(looked_up(F.regexp_extract_all(body, F.lit("(?i)" + lex.java(pattern)), F.lit(0)), spelled))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in found)))))


def id_tokens(model_id: Column) -> Column:
    """The keys that an API's model id may stand for: without path, dates and channels, with and without the family's stem."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(model_id, F.lit("")))), "^models/", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[-@][0-9]{6,8}$", ""), "-(latest|preview|exp|experimental|thinking)$", "")
    full = text.squash(s)
    out = [F.when(F.length(full) >= 3, full)]
    out += [F.when(full.startswith(stem) & (F.length(full) > len(stem) + 2), F.substring(full, F.lit(len(stem) + 1), F.length(full))) for stem in ("claude", "gpt", "gemini", "grok")]
    return F.array_compact(F.array(*out))


def handle_of(handle: Column, url: Column) -> Column:
    """The account, as given or as the post's URL tells."""
    own = F.lower(F.regexp_replace(F.trim(F.coalesce(handle, F.lit(""))), "^@", ""))
    name, path = text.host(F.coalesce(url, F.lit(""))), F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-z]+://[^/?#]*([^?#]*)", 1)
    told = F.when(name.isin("x.com", "twitter.com"), F.regexp_extract(path, "^/+([^/]+)/+status(?:/|$)", 1)).when(name == "bsky.app", F.regexp_extract(path, "^/+profile/+([^/]+)/+post(?:/|$)", 1))
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(F.regexp_replace(F.lower(told), "^@", ""), F.lit("")))


def status_id(url: Column) -> Column:
    """The id of a post in its URL on X or Bluesky; else null."""
    name, path = text.host(F.coalesce(url, F.lit(""))), F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-z]+://[^/?#]*([^?#]*)", 1)
    found = F.when(name.isin("x.com", "twitter.com"), F.regexp_extract(path, "^/+[^/]+/+status/+([^/]+)", 1)).when(name == "bsky.app", F.regexp_extract(path, "^/+profile/+[^/]+/+post/+([^/]+)", 1))
    return F.nullif(found, F.lit(""))


def quoted_in_text(body: Column, own_url: Column) -> Column:
    """The first id of a post on X that a text links and that isn't its own; else null."""
    ids = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?i)(?:x|twitter)\.com/[A-Za-z0-9_]+/status/(\d+)"), F.lit(1))
    return F.get(F.filter(ids, lambda i: F.coalesce(i != status_id(own_url), F.lit(True))), F.lit(0))


def origin_tokens(platform: Column, handle: Column, url: Column, quoted: Column) -> Column:
    """Everything by which two sources can be one origin: account, own post, quoted post, domain; else the URL."""
    kind = F.coalesce(F.nullif(F.lower(F.trim(F.coalesce(platform, F.lit("")))), F.lit("")), F.lit("unknown"))
    name, post = text.host(F.coalesce(url, F.lit(""))), status_id(url)
    account = handle_of(handle, url)
    found = F.array_compact(F.array(
        F.when(account.isNotNull(), F.concat(kind, F.lit(":account:"), account)),
        F.when(post.isNotNull(), F.concat(kind, F.lit(":post:"), post)),
        F.when(quoted.isNotNull(), F.concat(F.when(quoted.rlike(r"^[0-9]+$"), "twitter").otherwise(kind), F.lit(":post:"), quoted)),
        F.when((name != "") & kind.isin("web", "press", "official"), F.concat(kind, F.lit(":domain:"), name)),
    ))
    return F.array_distinct(F.when(F.size(found) == 0, F.array(F.concat(kind, F.lit(":url:"), F.coalesce(url, F.lit("unknown"))))).otherwise(found))


def token_links(rows: DataFrame, tokens: Column, scope: list[str]) -> DataFrame:
    """Distinct (scope columns, a, b): a row's first token with each of its tokens. Tables of links add up, so they can be stored."""
    named = rows.select(*scope, tokens.alias("t")).where(F.size("t") > 0)
    return named.select(*scope, F.col("t")[0].alias("a"), F.explode("t").alias("b")).distinct()


def with_component(rows: DataFrame, scope: list[str], tokens: Column, name: str) -> DataFrame:
    """Add the smallest token of the component that a row's tokens form with those of others in its scope."""
    of = lambda c: F.concat_ws("|", *scope, c)
    links = token_links(rows, tokens, scope).where("a <> b")
    roots = connected_components(links.select(of("a").alias("a"), of("b").alias("b")))
    marked = rows.withColumn("_first", F.when(F.size(tokens) > 0, of(F.get(tokens, F.lit(0)))))
    return marked.join(roots, F.col("_first") == F.col("node"), "left").withColumn(name, F.coalesce("root", "_first")).drop("_first", "node", "root")


def identity_tokens(family: Column, key: Column, label: Column, codename: Column) -> Column:
    """All names of a row's model: its key, its label, and each part of its codename."""
    own, parts = squashed(label), F.transform(split_label(codename), text.squash)
    found = F.concat(F.array_compact(F.array(key, F.when(F.length(own) >= 2, own))), F.filter(parts, lambda p: F.length(p) >= 2))
    return F.array_distinct(found)


def evidence_rank(quality: Column, evidence: Column, speculative: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for pair in lex.QUALITY_RANK.items() for x in pair))
    kinds = F.create_map(*(F.lit(x) for pair in lex.EVIDENCE_RANK.items() for x in pair))
    return F.when(speculative, -100).otherwise(F.greatest(F.coalesce(F.try_element_at(ranks, quality), F.lit(0)) * 10, F.coalesce(F.try_element_at(kinds, evidence), F.lit(0))))


def account_rank(quality: Column, verified: Column, followers: Column, handle: Column) -> Column:
    return F.when(quality == "tracked_leaker", 0).when(F.coalesce(verified, F.lit(False)) & (F.coalesce(followers, F.lit(0)) >= 10_000), 8).when(handle.isNotNull(), 4).otherwise(0)


def cards(claims: DataFrame) -> DataFrame:
    """One card for each component of claims (valid ones with family, key, names, source columns): counts, lead, strength and the display gate.

    A card's sources count by origin; of claims the one with the best evidence leads, then the newer one.
    """
    from_ = origin_tokens(F.col("platform"), F.col("handle"), F.col("url"), F.col("quoted"))
    spoken = claims.withColumn("tokens", identity_tokens(F.col("family"), F.col("key"), F.col("canon_label"), F.col("canon_codename"))).withColumn("sources", from_)
    grouped = cut(with_component(cut(spoken, "claims-and-tokens"), ["family"], F.col("tokens"), "card"), "carded")
    sourced = with_component(grouped, ["card"], F.col("sources"), "origin")
    rank = evidence_rank(F.col("quality"), F.col("evidence_kind"), F.lit(False))
    sort = F.greatest(rank, account_rank(F.col("quality"), F.col("verified"), F.col("followers"), handle_of(F.col("handle"), F.col("url"))))
    lead = F.max(F.struct(rank.alias("rank"), sort.alias("sort"), "posted_at", "id", "claim_type"))
    named = F.min(F.struct((-F.when(F.col("canon_label").isNotNull(), 20).otherwise(0) - F.when(F.col("canon_codename").isNotNull(), 10).otherwise(0)).alias("s"), (-F.unix_micros("posted_at")).alias("t"), "id", F.coalesce("canon_label", F.lit("")).alias("l"), F.coalesce("canon_codename", F.lit("")).alias("c"), "canon_label", "canon_codename"))
    made = sourced.groupBy("family", "card").agg(
        F.count_distinct("origin").alias("mention_count"), F.count_distinct("platform").alias("platform_count"), F.max(is_vetted(F.col("quality"), F.col("claim_mode"), F.col("evidence_kind"))).alias("vetted"),
        lead.alias("lead"), named.alias("named"), F.max(rank).alias("evidence"), F.min("posted_at").alias("first_seen_at"), F.max("posted_at").alias("last_seen_at"),
    )
    strong = F.col("vetted") | (F.col("mention_count") >= 3) | ((F.col("mention_count") >= 2) & (F.col("platform_count") >= 2))
    return made.select(
        "family", "card", F.col("named.canon_label").alias("label"), F.col("named.canon_codename").alias("codename"), F.col("lead.claim_type").alias("claim_type"), "mention_count", "platform_count", "vetted",
        strong.alias("strong"), (F.col("evidence") * 10_000 + F.col("platform_count") * 100 + F.col("mention_count")).alias("strength"), "first_seen_at", "last_seen_at",
    )
