"""The rumour accumulator as a stream: products as keyed state, an event-time timer for the day on which one leaves the board.

State of a product: one value with the best claims by type, the span, platforms and expected times; and a map of source tokens, in which
each token names one that it is tied to, up to its origin, which holds the origin's best source. Ties only add up, so any split of the
claims into micro-batches gives the rows of ``operators.products.accumulate``. A micro-batch reads and writes the tokens that
its claims name; to list sources it reads the product's origins once. State lies in RocksDB, so a product with many origins needn't fit in memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from pulsegrid.operators import products, rumors
from pulsegrid.streaming.tables import read_newest, snapshot_into

#: Days after the last claim on which a product leaves the board.
OPEN_DAYS = 21
DAY_MS = 86_400_000
OUT = (
    "family string, cluster_key string, claim_type string, claim_summary string, eta_text string, eta_date string, eta_conflicting boolean, mention_count long, "
    "platforms array<string>, sources array<string>, has_credible_source boolean, first_us long, last_us long, is_open boolean"
)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Origins:
    """Tokens tied together, over a map state, with the tokens of a micro-batch held aside until ``store``.

    An entry is (token it is tied to or itself, its origin's best source or null).
    """

    def __init__(self, state):
        self.state, self.held, self.changed = state, {}, set()

    def get(self, token: str):
        if token not in self.held:
            found = self.state.getValue((token,)) if self.state.containsKey((token,)) else None
            self.held[token] = (found[0], tuple(found[1:])) if found else None
        return self.held[token]

    def put(self, token: str, up: str, best) -> None:
        self.held[token] = (up, best)
        self.changed.add(token)

    def root(self, token: str) -> str:
        path = []
        while self.get(token)[0] != token:
            path.append(token)
            token = self.get(token)[0]
        for t in path[:-1]:  # shorten the way for the next time
            self.put(t, token, None)
        return token

    def add(self, tokens: list[str], best: tuple) -> int:
        """Tie tokens and note a source of theirs; how many origins that makes more."""
        for t in tokens:
            if self.get(t) is None:
                self.put(t, t, None)
        roots = sorted({self.root(t) for t in tokens})
        known = [self.get(r)[1] for r in roots]
        top = max([best, *(k for k in known if k is not None and k[0] is not None)])
        self.put(roots[0], roots[0], top)
        for r in roots[1:]:
            self.put(r, roots[0], None)
        return 1 - sum(k is not None and k[0] is not None for k in known)

    def store(self) -> None:
        for t in self.changed:
            up, best = self.held[t]
            self.state.updateValue((t,), (up, *(best or (None, None, None, None))))

    def best(self, keep: int) -> list[str]:
        """URLs of the best sources of the origins, in order."""
        import heapq

        tops = ((x[1], x[2], x[3], x[4], k[0]) for k, x in self.state.iterator() if x[1] is not None and x[0] == k[0])
        ranked = heapq.nsmallest(keep, tops, key=lambda s: (-s[0], -s[1], -s[2], Reversed(s[3]), s[4]))
        return [s[3] for s in ranked]


class Reversed(str):
    def __lt__(self, other: str) -> bool:
        return str.__gt__(self, other)


class Accumulator(StatefulProcessor):
    """Of each product that claims arrive for, its row; and one that says it's no longer open when its time has come."""

    def __init__(self, keep: int = products.KEEP, open_days: int = OPEN_DAYS):
        self.keep, self.open_days = keep, open_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getValueState("said", "parts string")
        self.tokens = handle.getMapState("tokens", "token string", "up string, rank int, at long, reach long, url string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.said.get() if self.said.exists() else None
        s = json.loads(held[0]) if held else {"best": {}, "timed": {}, "platforms": [], "credible": False, "first": None, "last": None, "key": [None, None], "date": [None, None], "origins": 0, "timer": None}
        origins, platforms = Origins(self.tokens), set(s["platforms"])
        for batch in rows:
            for c in batch.to_dict("records"):
                kind, claim = c["claim_type"], [None if pd.isna(x) else x for x in c["lead"].values()] if isinstance(c["lead"], dict) else list(c["lead"])
                for name, fits in (("best", True), ("timed", claim[-1] is not None or claim[-2] is not None)):
                    if fits and (kind not in s[name] or larger(claim, s[name][kind])):
                        s[name][kind] = claim
                for name, x in (("key", c["eta_key"]), ("date", c["eta_date"])):
                    if isinstance(x, str):
                        low, high = s[name]
                        s[name] = [x if low is None else min(low, x), x if high is None else max(high, x)]
                if isinstance(c["platform"], str):
                    platforms.add(c["platform"])
                at = int(c["at"])
                s["first"], s["last"] = at if s["first"] is None else min(s["first"], at), at if s["last"] is None else max(s["last"], at)
                s["credible"] = bool(s["credible"] or (c["credible"] is True or c["credible"] == 1))
                best = (int(c["rank"]), at, int(c["reach"]), c["url"])
                s["origins"] += origins.add(list(c["tokens"]), best)
        origins.store()
        s["platforms"] = sorted(platforms)
        due = s["last"] // 1000 + self.open_days * DAY_MS
        if s["timer"] != due:
            if s["timer"] is not None:
                self.handle.deleteTimer(s["timer"])
            self.handle.registerTimer(due)
            s["timer"] = due
        self.said.update((json.dumps(s),))
        yield self.row(key, s, origins, due > timerValues.getCurrentWatermarkInMs())

    def row(self, key: tuple, s: dict, origins: Origins, is_open: bool) -> pd.DataFrame:
        kind = max(s["best"], key=lambda k: sortable(s["best"][k]))
        timed = s["timed"].get(kind) or [None] * 8
        differs = any(low is not None and low != high for low, high in (s["key"], s["date"]))
        return pd.DataFrame([{
            "family": key[0], "cluster_key": key[1], "claim_type": kind, "claim_summary": s["best"][kind][5], "eta_text": timed[6], "eta_date": timed[7], "eta_conflicting": differs,
            "mention_count": s["origins"], "platforms": s["platforms"], "sources": origins.best(self.keep), "has_credible_source": s["credible"], "first_us": s["first"], "last_us": s["last"], "is_open": is_open,
        }])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = json.loads(self.said.get()[0])
        s["timer"] = None
        self.said.update((json.dumps(s),))
        yield self.row(key, s, Origins(self.tokens), False)

    def close(self) -> None:
        pass


def sortable(claim: list) -> list:
    """A claim as what compares: nulls are smallest."""
    return [(x is not None, x) if x is not None else (False,) for x in claim]


def larger(a: list, b: list) -> bool:
    return sortable(a) > sortable(b)


def accumulate(claims: DataFrame, lateness: str, keep: int = products.KEEP, open_days: int = OPEN_DAYS) -> DataFrame:
    """The products' changes as a stream, from a stream of claims; claims later than ``lateness`` are dropped."""
    rows = claims.withWatermark("posted_at", lateness).select(
        *products.PRODUCT, "claim_type", products.lead().alias("lead"), products.eta_key().alias("eta_key"), "eta_date", "platform", F.unix_micros("posted_at").alias("at"),
        F.coalesce("credible", F.lit(False)).alias("credible"), F.col("rank").cast("int").alias("rank"), F.coalesce("reach", F.lit(0)).cast("long").alias("reach"), F.coalesce("url", F.lit("")).alias("url"),
        rumors.source_tokens().alias("tokens"), "posted_at",
    )
    return rows.groupBy(*products.PRODUCT).transformWithStateInPandas(Accumulator(keep, open_days), OUT, "Update", "EventTime")


def run_available(changes: DataFrame, folder: str) -> DataFrame:
    """Take in all claims that have arrived; the products so far. A later call with the same folder goes on where this one ended."""
    spark = changes.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, PROVIDER)
    try:
        changes.writeStream.trigger(availableNow=True).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(snapshot_into(folder, products.PRODUCT, F.col("last_us"), F.col("mention_count"))).start().awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    table = read_newest(spark, folder, changes.schema)
    return table.select(*(c for c in table.columns if not c.endswith("_us") and c != "is_open"), F.timestamp_micros("first_us").alias("first_seen_at"), F.timestamp_micros("last_us").alias("last_seen_at"), "is_open")
