"""What a text says of a version near where it names it: the window of the claim, its kind and its expected time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import lexicons as lex
from pulsegrid.functions import text

#: Characters on either side of a name, and the longest sentence that is a window of its own.
RADIUS, SENTENCE = 180, 360


def with_window(rows: DataFrame, body: str, pattern: str, name: str = "window") -> DataFrame:
    """Add the first match's surroundings: its sentence, if that isn't longer than ``SENTENCE`` characters, else ``RADIUS`` characters either side; null without a match.

    A sentence begins after a line's end, a full stop or a semicolon before white space, and ends with a line's end, a full stop, or such a semicolon.
    """
    said = F.regexp_extract(body, "(?i)" + lex.java(pattern), 0)
    rows = rows.withColumn("_said", said).withColumn("_at", F.regexp_instr(body, F.lit("(?i)" + lex.java(pattern))) - 1)  # from 0, as all places here
    rows = rows.withColumn("_before", F.substring(F.col(body), F.lit(1), F.col("_at"))).withColumn("_end", F.col("_at") + F.length("_said"))
    rows = rows.withColumn("_after", F.substring(F.col(body), F.col("_end") + 1, F.length(body)))

    def last(mark: str) -> Column:
        found = F.instr(F.reverse("_before"), mark[::-1])
        return F.when(found > 0, F.length("_before") - found - len(mark) + 1).otherwise(-1)

    def next_(mark: str) -> Column:
        found = F.instr("_after", mark)
        return F.when(found > 0, F.col("_end") + found - 1)

    rows = rows.withColumn("_left", F.greatest(last("\n"), last(". "), last("; "))).withColumn("_right", F.least(next_("\n"), next_("."), next_("; ")))
    whole = (F.col("_right") > F.col("_left")) & (F.col("_right") - F.col("_left") <= SENTENCE)
    begin = F.greatest(F.lit(0), F.col("_at") - RADIUS)
    window = F.when(whole, F.substring(F.col(body), F.col("_left") + 2, F.col("_right") - F.col("_left"))).otherwise(F.substring(F.col(body), begin + 1, F.col("_end") + RADIUS - begin))
    return rows.withColumn(name, F.when(F.col("_at") >= 0, window)).drop("_said", "_at", "_before", "_after", "_end", "_left", "_right")


def eta_said(window: Column) -> Column:
    """The first of the known times that a window gives, in one spelling."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(lex.ETA_SAID):
        out = F.when(text.has(window, pattern), name).otherwise(out)
    return out


def kind_said(window: Column) -> Column:
    """The kind of claim that a window makes; null if none."""
    kinds = (("delayed", lex.DELAY_SAID), ("in_testing", lex.TESTING_SAID), ("imminent", lex.IMMINENT_SAID), ("launch", lex.LAUNCH_SAID))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(kinds):
        out = F.when(text.has(window, pattern), name).otherwise(out)
    return out


def recovered_claims(posts: DataFrame, body: str = "text") -> DataFrame:
    """Posts that make a claim on the recovered version, with version_label, claim_type, claim_summary and eta_text from its window (a time also from the whole text)."""
    named = posts.where(text.has(F.col(body), lex.VERSION_SAID))  # few texts do, so the rest is spared the search for windows
    rows = with_window(named, body, lex.VERSION_SAID, "_window")
    # kind and time come out of a generator, whose filter isn't pushed below the window's many steps
    kind = kind_said(F.col("_window"))
    said = F.when(kind.isNotNull(), F.struct(kind.alias("claim_type"), F.coalesce(eta_said(F.col("_window")), eta_said(F.col(body))).alias("eta_text")))
    rows = rows.select("*", F.inline(F.array_compact(F.array(said))))
    label = F.when(F.ltrim(F.regexp_extract(body, "(?i)" + lex.java(lex.VERSION_SAID), 0)).ilike("gemini%"), "Gemini 3.5 Pro").otherwise("3.5 Pro")
    summary = (
        F.when((F.col("claim_type") == "delayed") & F.col("eta_text").isNotNull(), F.concat(F.lit("Gemini 3.5 Pro is delayed to "), "eta_text", F.lit(".")))
        .when(F.col("claim_type") == "delayed", "Gemini 3.5 Pro is delayed.")
        .when(F.col("claim_type") == "in_testing", "Gemini 3.5 Pro is being discussed as in testing.")
        .when(F.col("claim_type") == "imminent", "Gemini 3.5 Pro is being discussed as imminent.")
        .otherwise("Gemini 3.5 Pro is being discussed as an upcoming release.")
    )
    return rows.withColumn("version_label", label).withColumn("claim_summary", summary).drop("_window")
