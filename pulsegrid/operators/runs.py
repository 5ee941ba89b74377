"""Collector runs: what a run's summary says of it, its record, the window it belongs to, and whether its cost is within the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names that a counter may have in a summary, in the order they are tried.
COUNTERS = {
    "posts_found": ["posts_found", "fetched", "total"],
    "posts_classified": ["classification_success", "classificationSuccess", "posts_classified", "classified", "inserted"],
    "filtered_candidates": ["filtered_candidates", "filtered"],
    "net_new_rows": ["net_new_rows", "inserted"],
    "classification_queued": ["classification_queued", "classificationQueued", "queued_classifications"],
    "duplicate_conflicts": ["duplicate_conflicts"],
}


def metrics(runs: DataFrame, summary: str = "summary") -> DataFrame:
    """Counters, errors and status from a JSON summary: a run with errors is partial if it brought something, else failed."""
    field = lambda name: F.get_json_object(summary, f"$.{name}")
    counts = {name: F.coalesce(*(field(n).try_cast("int") for n in names), F.lit(0)) for name, names in COUNTERS.items()}
    errors = F.coalesce(F.from_json(field("errors"), "array<string>"), F.array().cast("array<string>"))
    given, stuck = F.coalesce(field("status"), F.lit("success")), F.exists(errors, lambda e: e.rlike("(?i)classif|quota"))
    some = (counts["posts_found"] > 0) | (counts["posts_classified"] > 0) | (counts["net_new_rows"] > 0)
    status = (
        F.when(field("skipped") == "true", "skipped")
        .when((given == "success") & (counts["filtered_candidates"] > 0) & (counts["posts_classified"] == 0) & stuck, F.when(counts["classification_queued"] > 0, "partial").otherwise("failed"))
        .when((given == "success") & (F.size(errors) > 0), F.when(some, "partial").otherwise("failed"))
        .otherwise(given)
    )
    return runs.select("*", status.alias("run_status"), *(c.alias(n) for n, c in counts.items()), F.size(errors).alias("n_errors"))


def append(record: DataFrame, path: str) -> None:
    """Add run records to their log."""
    record.write.mode("append").parquet(path)


def window_label(at: Column, zone: str, times: list[str], grace: int) -> Column:
    """The name of the first daily window (HH:MM) that an instant lies in, from its time up to ``grace`` minutes later."""
    local = F.from_utc_timestamp(at, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    out = F.lit(None).cast("string")
    names = ["morning", "afternoon", "evening"]
    for i, time in reversed(list(enumerate(sorted(set(times))))):
        start = int(time[:2]) * 60 + int(time[3:])
        out = F.when(minute.between(start, start + grace), names[i] if i < len(names) else f"window_{i + 1}").otherwise(out)
    return out


def budget(monthly: Column, today: Column, planned: Column, month_limit: float, day_limit: float) -> Column:
    """Why a planned charge isn't allowed; null if it is."""
    cost = F.greatest(F.coalesce(planned, F.lit(0.0)), F.lit(0.0))
    return F.when(monthly.isNull(), "budget unreadable").when(monthly + cost > month_limit, "monthly budget exceeded").when(today + cost > day_limit, "daily budget exceeded")
