"""Benchmark leaderboards: successors, leading band, verdicts of pairs, scoring dates, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.shared import cut

VERSION = r"(?<![a-z0-9.])k?(\d+(?:\.\d+)*)(?![a-z0-9.])"


def family(label: Column) -> Column:
    """A label without its version token, in one spelling."""
    bare = F.regexp_replace(label, "(?i)" + VERSION, "")
    return F.lower(F.trim(F.regexp_replace(bare, r"[\s-]+", " ")))


def version(label: Column) -> Column:
    """The version token's numbers, which compare one by one; null without one."""
    token = F.regexp_extract(F.lower(label), VERSION, 1)
    return F.when(token != "", F.transform(F.split(token, r"\."), lambda x: x.cast("int")))


def successors(models: DataFrame) -> DataFrame:
    """Add ``successor``: the newest ranked model of a label's family, if it is newer."""
    rows = models.withColumn("family", family(F.col("label"))).withColumn("version", version(F.col("label")))
    newest = rows.where("ranked and version is not null").groupBy("family").agg(F.max(F.struct("version", "name")).alias("top"))
    joined = rows.join(newest, "family", "left")
    return joined.withColumn("successor", F.when((F.col("top.version") > F.col("version")) & (F.col("top.name") != F.col("name")), F.col("top.name"))).drop("top", "version")


def lineup(models: DataFrame) -> DataFrame:
    """(name, successor, final): the model that comes after each one (name, label, ranked, is_baseline, superseded_by), and the one at the chain's end.

    A declared successor that is ranked goes before the newest ranked model of the label's family. Baselines neither have one nor are one. ``final`` is null where a chain runs into a circle.
    """
    base = F.coalesce("is_baseline", F.lit(False))
    real = models.where(~base).withColumn("ranked", F.coalesce("ranked", F.lit(True))).withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "name"))
    known = real.where("ranked").select(F.col("name").alias("superseded_by"), F.lit(True).alias("_known")).distinct()
    inferred = successors(real).join(known, "superseded_by", "left")
    declared = F.when(F.col("_known") & (F.col("superseded_by") != F.col("name")), F.col("superseded_by"))
    nexts = inferred.select("name", F.coalesce(declared, "successor").alias("successor"))
    rows = nexts.unionByName(models.where(base).select("name", F.lit(None).cast("string").alias("successor")))
    return rows.join(chain_ends(nexts.where("successor is not null")), "name", "left")


def chain_ends(links: DataFrame) -> DataFrame:
    """(name, final) for links (name, successor), one for each name: the end of the chain, by pointer jumping; null for chains that run into a circle.

    A round doubles the length followed, so after as many rounds as the number of links has binary digits only circles still go on.
    """
    now = cut(links.select("name", F.col("successor").alias("final")), "chains")
    for _ in range(max(1, now.count()).bit_length() + 1):
        onward = now.select(F.col("name").alias("_at"), F.col("final").alias("_end"))
        if now.join(onward, F.col("final") == F.col("_at"), "left_semi").isEmpty():
            return now
        now = cut(now.join(onward, F.col("final") == F.col("_at"), "left").select("name", F.coalesce("_end", "final").alias("final")), "chains")
    onward = now.select(F.col("name").alias("_at"))
    return now.join(onward, F.col("final") == F.col("_at"), "left").select("name", F.when(F.col("_at").isNull(), F.col("final")).alias("final"))


def leading_band(models: DataFrame, board: str) -> DataFrame:
    """On each board the models, from the top down to the first gap, whose interval reaches the leader's lower bound; none if alone."""
    order = Window.partitionBy(board).orderBy(F.desc("score"), "name")
    rows = models.withColumn("lead_lo", F.first("lo").over(order)).withColumn("reaches", F.col("hi") >= F.col("lead_lo"))
    rows = rows.withColumn("inside", F.min(F.col("reaches").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.where("inside = 1").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(board)))
    return rows.where("size > 1").select(board, "name", "score")


def verdicts(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (previous, current) with the pair's record turned to current minus previous, in points, and what it says."""
    keyed = pairs.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
    rows = wanted.withColumn("x", F.least("previous", "current")).withColumn("y", F.greatest("previous", "current")).join(keyed, ["x", "y"])
    same = F.col("a") == F.col("current")
    delta = F.when(same, F.col("delta")).otherwise(-F.col("delta"))
    low, high = F.when(same, F.col("lo")).otherwise(-F.col("hi")), F.when(same, F.col("hi")).otherwise(-F.col("lo"))
    said = (
        F.when(F.col("winner") == F.col("current"), "decisive-up").when(F.col("winner") == F.col("previous"), "decisive-down")
        .when(low > 0, "suggestive-up").when(high < 0, "suggestive-down").when(delta > 0, "up").when(delta < 0, "down").otherwise("even")
    )
    points = lambda c, name: F.round(100 * c, 6).alias(name)
    return rows.select("previous", "current", points(delta, "delta_points"), points(low, "lo_points"), points(high, "hi_points"), said.alias("verdict"))


def scoring_dates(models: DataFrame, run_date: str, top: int = 5) -> DataFrame:
    """Labels by the date they were scored: that of their price, but not before the run; of each date the ``top`` best by name."""
    dated = models.withColumn("scored_on", F.greatest(F.coalesce("price_date", F.lit("")), F.lit(run_date)))
    placed = dated.withColumn("_r", F.row_number().over(Window.partitionBy("scored_on").orderBy(F.desc("score"), "name")))
    best = F.array_sort(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", "name"))))
    return placed.groupBy("scored_on").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.transform(best, lambda x: x["name"])).alias("top_names"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a new snapshot adds, removes, rescores or reprices."""
    b, a = before.select("name", F.col("score").alias("old_score"), F.col("price").alias("old_price")), after.select("name", F.col("score").alias("new_score"), F.col("price").alias("new_price"))
    kind = F.when(F.col("old_score").isNull(), "added").when(F.col("new_score").isNull(), "removed").when(F.col("old_score") != F.col("new_score"), "rescored").when(F.col("old_price") != F.col("new_price"), "repriced")
    return b.join(a, "name", "full_outer").withColumn("change", kind).where("change is not null").select("name", "change", "old_score", "new_score")


def priced(models: DataFrame, registry: DataFrame) -> DataFrame:
    """Models (name, score, price_in, price_out at the test) with today's prices of a registry (name, price_in, price_out, pending_in, pending_out, effective).

    A registry's price goes before that of the test, and a model without either costs nothing. Where both prices of the test are known and one has changed, they are kept as at_test prices; prices to
    come are carried whatever their date. Scores have one place.
    """
    now = registry.select("name", F.col("price_in").alias("_in"), F.col("price_out").alias("_out"), "pending_in", "pending_out", "effective")
    rows = models.join(now, "name", "left")
    price_in, price_out = F.coalesce("_in", "price_in", F.lit(0.0)), F.coalesce("_out", "price_out", F.lit(0.0))
    repriced = F.col("price_in").isNotNull() & F.col("price_out").isNotNull() & ((price_in != F.col("price_in")) | (price_out != F.col("price_out")))
    return rows.select(
        "name", F.round("score", 1).alias("score"), price_in.alias("price_in"), price_out.alias("price_out"), F.when(repriced, F.col("price_in")).alias("at_test_in"), F.when(repriced, F.col("price_out")).alias("at_test_out"),
        "pending_in", "pending_out", F.when(F.col("pending_in").isNotNull() | F.col("pending_out").isNotNull(), F.col("effective")).alias("effective"),
    )
