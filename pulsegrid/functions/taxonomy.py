"""Categories and their normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public taxonomy.
SENTIMENTS = ["positive", "negative", "neutral"]
COMPLAINTS = [
    "lazy_responses",
    "hallucinations",
    "refusals",
    "coding_quality",
    "speed",
    "general_drop",
    "pricing_value",
    "censorship",
    "context_window",
    "api_reliability",
    "multimodal_quality",
    "reasoning",
]
COMPLAINT_ALIASES = {"reliability": "api_reliability"}
PRAISES = [
    "output_quality",
    "coding_quality",
    "speed",
    "reasoning",
    "creativity",
    "value",
    "reliability",
    "context_handling",
    "multimodal_quality",
    "general_improvement",
]


def member(value: Column, allowed: list[str]) -> Column:
    """The value if it is one of the allowed ones, else null."""
    return F.when(value.isin(allowed), value)


def sentiment(value: Column) -> Column:
    return member(value, SENTIMENTS)


def complaint(value: Column) -> Column:
    renamed = value
    for old, new in COMPLAINT_ALIASES.items():
        renamed = F.when(value == old, F.lit(new)).otherwise(renamed)
    return member(renamed, COMPLAINTS)


def praise(value: Column) -> Column:
    return member(value, PRAISES)


def complaint_label(value: Column) -> Column:
    """The label to show: the category in words, but for two that are written otherwise."""
    category = complaint(value)
    words = F.replace(category, F.lit("_"), F.lit(" "))
    named = F.when(category == "pricing_value", "Pricing / value").when(category == "api_reliability", "API reliability")
    return F.coalesce(named, F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 100)), F.lit("Other"))


def complaint_sql(column: str) -> str:
    """The normaliser as SQL."""
    values = ", ".join(f"'{c}'" for c in COMPLAINTS)
    aliases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in COMPLAINT_ALIASES.items())
    return f"(CASE WHEN (CASE {column} {aliases} ELSE {column} END) IN ({values}) THEN (CASE {column} {aliases} ELSE {column} END) END)"


# Names of sources, and the orders in which models and surfaces are listed.
SOURCE_LABELS = {
    "reddit": "Reddit", "hackernews": "Hacker News", "bluesky": "Bluesky", "mastodon": "Mastodon", "lobsters": "Lobsters", "lemmy": "Lemmy", "devto": "Dev.to", "stackoverflow": "Stack Overflow",
    "medium": "Medium", "discourse": "Discourse", "github": "GitHub", "twitter": "𝕏", "appstore": "App Store", "openrouter": "OpenRouter",
}
MODEL_ORDER = ["claude", "chatgpt", "gemini", "grok"]
SURFACE_ORDER = ["product_app", "api", "cli", "sdk", "unknown"]


def source_label(source: Column) -> Column:
    """A source's name as it's shown; an unknown one's own."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SOURCE_LABELS.items() for x in pair)), source), source)


def in_order(value: Column, order: list[str]) -> Column:
    """A value's place in a list, those not in it last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at - 1).otherwise(99).cast("int")


def time_ago(at: Column, now: Column) -> Column:
    """How long ago, in minutes, hours or days; "just now" below a minute and in the future, and nothing for a time that is missing."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(at)) / 60_000_000)
    hours = F.floor(minutes / 60)
    said = F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes, F.lit("m ago"))).when(hours < 24, F.concat(hours, F.lit("h ago"))).otherwise(F.concat(F.floor(hours / 24), F.lit("d ago")))
    return F.when(at.isNull(), "").otherwise(said)
