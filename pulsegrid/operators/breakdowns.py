"""Counts and shares: breakdowns, trends week over week, agreement between classifiers, usage, stratified picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.scoring import half_up


def with_pct(rows: DataFrame, within: list[str]) -> DataFrame:
    """Add each count's share of its group in whole per cent."""
    return rows.withColumn("pct", half_up(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*within))))


def breakdown(posts: DataFrame, column: Column, name: str) -> DataFrame:
    """Classified posts of each model by a value, without nulls."""
    rows = posts.where("status = 'classified'").select("model_id", column.alias(name)).where(F.col(name).isNotNull())
    return rows.groupBy("model_id", name).agg(F.count(F.lit(1)).alias("n"))


def week_over_week(posts: DataFrame, category: Column, now: Column, least: int = 3, least_total: int = 5) -> DataFrame:
    """Categories of the last seven days against the seven before; models with few such posts are left out."""
    days = lambda n: now - F.make_dt_interval(days=F.lit(n))
    rows = posts.where("status = 'classified'").select("model_id", category.alias("category"), "posted_at").where("category is not null")
    rows = rows.where(F.col("posted_at") >= days(14))
    counted = rows.groupBy("model_id", "category").agg(F.count_if(F.col("posted_at") >= days(7)).alias("this_week"), F.count_if(F.col("posted_at") < days(7)).alias("last_week"))
    counted = counted.where(F.col("this_week") > least).withColumn("_total", F.sum("this_week").over(Window.partitionBy("model_id"))).where(F.col("_total") > least_total).drop("_total")
    change = F.when(F.col("last_week") == 0, 100).otherwise(F.round(100.0 * (F.col("this_week") - F.col("last_week")) / F.greatest("last_week", F.lit(1)), 0))
    return counted.withColumn("pct_change", change.cast("int"))


def audit(posts: DataFrame, windows: list[int], now: Column) -> DataFrame:
    """Counts over several trailing windows, by source, by sentiment and in all, in one pass with grouping sets."""
    spread = posts.withColumn("days", F.explode(F.array(*map(F.lit, windows)))).where(F.col("posted_at") >= now - F.make_dt_interval(days=F.col("days")))
    sets = [[F.col("days"), F.col("source")], [F.col("days"), F.col("sentiment")], [F.col("days")]]
    return spread.groupingSets(sets, "days", "source", "sentiment").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") < 0.65).alias("low_confidence"), F.count_if((F.col("sentiment") == "negative") & F.col("complaint").isNull()).alias("uncategorised")
    )


def stratified(rows: DataFrame, strata: list[str], quota: int, tie: str) -> DataFrame:
    """The first rows of each stratum in an order that looks random and is always the same."""
    order = F.md5(F.col(tie).cast("string"))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(order, tie))).where(F.col("_r") <= quota).drop("_r")


def post_key(url: Column, source: Column, translated: Column, content: Column, title: Column) -> Column:
    """By what rows of one post under several models are told: its URL, or else its source and the first 200 characters of its text."""
    full = lambda c: F.nullif(c, F.lit(""))
    said = F.coalesce(full(translated), full(content), full(title), F.lit(""))
    return F.coalesce(full(url), F.concat(F.coalesce(source, F.lit("")), F.lit("::"), F.substring(said, 1, 200)))


def agreement_report(reference: DataFrame, candidate: DataFrame, on: str) -> DataFrame:
    """One row: how a candidate classifier's results (status, relevant, sentiment, complaint, praise, language, translation) agree with reference ones.

    Of an id that repeats in either table one row counts, so none is multiplied. Failed and missing results are counted and nothing else; results that call a post irrelevant are
    counted where the reference has a sentiment. Sentiments are also rated by the reference's class; complaints only under negative posts with one other than "other", praises under
    positive ones. Languages agree if both are English or none, or the same; a translation is due for every other language and counts from ten characters on. Rates have three places, null without cases.
    """
    of = lambda rows, p, columns: rows.groupBy(on).agg(F.min(F.struct(*columns)).alias(p))
    both = of(reference, "r", ["sentiment", "complaint", "praise", "language"]).join(of(candidate, "c", ["status", "relevant", "sentiment", "complaint", "praise", "language", "translation"]), on, "left")
    failed = F.col("c").isNull() | (F.coalesce(F.col("c.status"), F.lit("ok")) != "ok")
    seen, has = ~failed & F.coalesce(F.col("c.relevant"), F.lit(False)), F.col("r.sentiment").isNotNull()
    same = lambda x: F.col(f"c.{x}").eqNullSafe(F.col(f"r.{x}"))
    plain = lambda c: F.when(~c.isin("", "en"), c)
    foreign = plain(F.col("r.language")).isNotNull()

    def rate(cases: Column, hit: Column, name: str) -> Column:
        return F.round(F.count_if(cases & hit) / F.nullif(F.count_if(cases), F.lit(0)), 3).alias(name)

    return both.agg(
        F.count(F.lit(1)).alias("sample_size"), F.count_if(failed).alias("failures"), F.count_if(~failed & ~seen & has).alias("newly_irrelevant"), F.count_if(seen & has).alias("comparable"), rate(seen & has, same("sentiment"), "sentiment_rate"),
        *(rate(seen & (F.col("r.sentiment") == k), same("sentiment"), f"{k}_rate") for k in ("positive", "negative", "neutral")),
        rate(seen & (F.col("r.sentiment") == "negative") & (F.coalesce(F.col("r.complaint"), F.lit("other")) != "other"), same("complaint"), "complaint_rate"), rate(seen & (F.col("r.sentiment") == "positive") & F.col("r.praise").isNotNull(), same("praise"), "praise_rate"),
        rate(seen, plain(F.col("r.language")).eqNullSafe(plain(F.col("c.language"))), "language_rate"), rate(seen & foreign, F.coalesce(F.length(F.trim("c.translation")) >= 10, F.lit(False)), "translation_rate"),
    )


def agreement(a: DataFrame, b: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """How often two classifiers give one post the same values, to three places; nulls agree with nulls. Of an id that repeats one row counts."""
    one = lambda rows: rows.groupBy(on).agg(F.min(F.struct(*columns)).alias("x")).select(on, "x.*")
    both = one(a).alias("a").join(one(b).alias("b"), on)
    return both.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")).cast("double")), 3).alias(f"{c}_rate") for c in columns))


def agreement_matrix(votes: DataFrame, on: str, voter: str, value: str) -> DataFrame:
    """Agreement of each pair of classifiers on the posts that both saw. Votes of a post meet in its own row, not in a self-join."""
    seen = votes.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(voter, value))).alias("v"))
    left = seen.select(F.posexplode("v").alias("i", "x"), "v").select("x", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("y"))
    pair = left.groupBy(F.col(f"x.{voter}").alias("a"), F.col(f"y.{voter}").alias("b"))
    return pair.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(f"x.{value}") == F.col(f"y.{value}")).cast("double")), 3).alias("rate"))


def usage(rows: DataFrame, key: str, amount: str, price: float, cached: str, cached_part: float = 0.1) -> DataFrame:
    """Sums, median, nearest-rank 95th percentile and cost, where cached amounts cost a part of the price.

    Median and percentile come from the counts of distinct amounts, summed up in order, so that no group is gathered as a whole;
    null amounts play no part in them.
    """
    sums = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(amount).alias("_all"),
        F.sum(amount).cast("double").alias("total"),
        F.round((F.sum(F.col(amount) - F.col(cached)) + F.sum(cached) * cached_part) * price, 6).alias("cost"),
    )
    counts = rows.where(F.col(amount).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(amount).cast("double").alias("_amount")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_to", F.sum("_n").over(Window.partitionBy("_key").orderBy("_amount").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = lambda place: F.min(F.when(F.col("_to") > place, F.col("_amount")))
    ranked = sums.join(counts, F.col(key).eqNullSafe(F.col("_key")), "left").groupBy(key, "n", "total", "cost")
    median = (at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2
    p95 = at(F.least(F.floor(F.col("_all") * 0.95), F.col("_all") - 1))
    return ranked.agg(F.round(median, 6).alias("median"), p95.alias("p95")).select(key, "n", "total", "median", "p95", "cost")
