"""Text functions over columns, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions import lexicons as lex


def has(text: Column, pattern: str, any_case: bool = True) -> Column:
    return text.rlike(("(?i)" if any_case else "") + lex.java(pattern))


def has_sql(text: str, pattern: str, any_case: bool = True) -> str:
    quoted = (("(?i)" if any_case else "") + pattern).replace("'", "''")
    return f"regexp_matches({text}, '{quoted}')"


def any_of(text: Column, patterns: list[str]) -> Column:
    return has(text, "|".join(f"(?:{p})" for p in patterns))


def any_of_sql(text: str, patterns: list[str]) -> str:
    return has_sql(text, "|".join(f"(?:{p})" for p in patterns))


def stripped(text: Column) -> Column:
    """Without URLs and tags, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"https?://[^\s]+", ""), "<[^>]*>", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


STRIPPED_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, 'https?://[^\s]+', '', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"


def long_enough(text: Column, least: int = 20) -> Column:
    return F.length(stripped(text)) >= least


def is_news(text: Column) -> Column:
    """A headline with its source and link, or a link with hardly any words."""
    return has(text, lex.HEADLINE, False) | (has(text, r"https?://[^\s]+") & (F.length(stripped(text)) < 40))


def has_experience(text: Column) -> Column:
    return any_of(text, lex.EXPERIENCE)


def is_promotion(text: Column) -> Column:
    bare, own = stripped(text), has_experience(stripped(text))
    link = has(text, r"https?://[^\s]+")
    call = has(bare, lex.CALL_TO_ACTION) & (link | has(bare, lex.PROMO_NOUN)) & ~own
    return any_of(bare, lex.ADVERT) | call | (has(bare, lex.ANNOUNCEMENT) & link & ~own)


def is_novelty(text: Column) -> Column:
    return any_of(text, [lex.BYLINE, lex.STUNT, lex.LAUNCH]) & ~has_experience(text)


def is_rumor(text: Column) -> Column:
    return any_of(text, lex.RUMOR_LEXICON)


def is_release(text: Column) -> Column:
    return has(text, lex.RELEASED) & (~has(text, lex.RELEASED_NARROWLY) | has(text, lex.RELEASED_WIDELY))


def flags_sql(text: str) -> dict[str, str]:
    """The flags' SQL by name."""
    bare = STRIPPED_SQL.format(text)
    link = has_sql(text, r"https?://[^\s]+")
    own = any_of_sql(bare, lex.EXPERIENCE)
    news = f"({has_sql(text, lex.HEADLINE, False)} OR ({link} AND length({bare}) < 40))"
    promo = f"({any_of_sql(bare, lex.ADVERT)} OR ({has_sql(bare, lex.CALL_TO_ACTION)} AND ({link} OR {has_sql(bare, lex.PROMO_NOUN)}) AND NOT {own}) OR ({has_sql(bare, lex.ANNOUNCEMENT)} AND {link} AND NOT {own}))"
    novelty = f"({any_of_sql(text, [lex.BYLINE, lex.STUNT, lex.LAUNCH])} AND NOT {any_of_sql(text, lex.EXPERIENCE)})"
    rumor = any_of_sql(text, lex.RUMOR_LEXICON)
    release = f"({has_sql(text, lex.RELEASED)} AND (NOT {has_sql(text, lex.RELEASED_NARROWLY)} OR {has_sql(text, lex.RELEASED_WIDELY)}))"
    return {"long_enough": f"length({bare}) >= 20", "news": news, "promotion": promo, "novelty": novelty, "experience": any_of_sql(text, lex.EXPERIENCE), "rumor": rumor, "release": release}


def surface(slug: Column, text: Column) -> Column:
    """The label of the product surface that a text speaks of: the model's first pattern that fits."""
    out = F.lit(None).cast("string")
    for model, patterns in reversed(list(lex.SURFACES.items())):
        for pattern, _, label in reversed(patterns):
            out = F.when((slug == model) & has(text, pattern), label).otherwise(out)
    return out


def surface_sql(slug: str, text: str) -> str:
    whens = " ".join(f"WHEN {slug} = '{m}' AND {has_sql(text, p)} THEN '{label}'" for m, ps in lex.SURFACES.items() for p, _, label in ps)
    return f"CASE {whens} END"


# The entities that markup commonly holds.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def plain_html(html: Column) -> Column:
    """Text of markup: scripts, styles and tags go, common entities are decoded, white space is collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for entity, plain in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, "[ \t\n\r]+", " "))


def plain_html_sql(html: str) -> str:
    out = rf"regexp_replace({html}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for entity, plain in ENTITIES.items():
        quoted = plain.replace("'", "''")
        out = f"replace({out}, '{entity}', '{quoted}')"
    return rf"trim(regexp_replace({out}, '[ \t\n\r]+', ' ', 'g'))"


def decoded(said: Column) -> Column:
    """Numeric entities, decimal and hexadecimal, as the characters that they stand for."""
    parts = F.split(said, "&#")

    def char(number: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")

    def one(p: Column) -> Column:
        rest, ten, six = F.regexp_replace(p, "^[^;]*;", ""), F.regexp_extract(p, "^([0-9]{1,6});", 1), F.regexp_extract(p, "^x([0-9a-fA-F]{1,5});", 1)
        return F.when(ten != "", F.concat(char(ten.try_cast("long")), rest)).when(six != "", F.concat(char(F.conv(six, 16, 10).try_cast("long")), rest)).otherwise(F.concat(F.lit("&#"), p))

    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))


def decoded_sql(said: str) -> str:
    rest = "regexp_replace(p, '^[^;]*;', '')"
    one = f"CASE WHEN regexp_matches(p, '^[0-9]{{1,6}};') THEN chr(regexp_extract(p, '^([0-9]+)', 1)::INTEGER) || {rest} WHEN regexp_matches(p, '^x[0-9a-fA-F]{{1,5}};') THEN chr(('0x' || regexp_extract(p, '^x([0-9a-fA-F]+)', 1))::INTEGER) || {rest} ELSE '&#' || p END"
    return f"(string_split({said}, '&#')[1] || array_to_string(list_transform(string_split({said}, '&#')[2:], lambda p: {one}), ''))"


def squash(label: Column) -> Column:
    """A label's letters and digits in lower case."""
    return F.regexp_replace(F.lower(label), "[^a-z0-9]", "")


def safe_url(url: Column) -> Column:
    return F.when(url.rlike(r"^https?://[^\s<>\"']+$"), url)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def domain_in(name: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or lies under one."""
    return name.rlike(r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$")


def source_quality(handle: Column, url: Column, platform: Column, quotes: Column, stored: Column | None = None) -> Column:
    """What kind of source a post is: as stored, if that's a known kind, else by its handle, then its domain, then its platform."""
    if stored is not None:
        return F.when(stored.isin(*lex.QUALITY_RANK), stored).otherwise(source_quality(handle, url, platform, quotes))
    h, name = F.regexp_replace(F.lower(F.trim(F.coalesce(handle, F.lit("")))), "^@", ""), host(F.coalesce(url, F.lit("")))
    platform = F.coalesce(platform, F.lit(""))
    return (
        F.when(h.isin(lex.TRACKED_LEAKERS), "tracked_leaker")
        .when(h.isin(lex.ARTIFACT_LEAKERS), "artifact_leak")
        .when(h.isin(lex.SCOOP_HANDLES), "press_scoop")
        .when(h.isin(lex.OFFICIAL_HANDLES), "official")
        .when(domain_in(name, lex.OFFICIAL_DOMAINS) | (platform == "official"), "official")
        .when(domain_in(name, lex.SCOOP_DOMAINS), "press_scoop")
        .when(domain_in(name, lex.ARTIFACT_DOMAINS) | (platform == "github"), "artifact_leak")
        .when(domain_in(name, lex.MARKET_DOMAINS) | (platform == "prediction_market"), "prediction_market")
        .when(quotes | domain_in(name, lex.ECHO_DOMAINS) | (platform == "press"), "press_echo")
        .otherwise("unknown")
    )
