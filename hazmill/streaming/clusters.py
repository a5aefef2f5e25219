"""Clustering of a stream of articles by event time: the first-fit rule, by date and place as in a batch, whatever the order of arrival.

Articles wait in state until the watermark has passed their day; a timer then places a day's articles in order, so that a cluster's first
date is its earliest and no cluster is wider than the tolerance. An article whose day was closed before it came is set apart (late, without a cluster).
An article without a date is placed on arrival among the clusters that are still open; a cluster without a date is forgotten once the watermark is a
retention beyond the moment it was made. State holds open days and open clusters only: clusters that no further day can join are dropped.

Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hazmill.functions.exprs import location_tokens
from hazmill.operators.events import TOLERANCE, partition_keys

OUT = "pos long, type string, country string, cluster int, late boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


class Clusterer(StatefulProcessor):
    """One (type, country): pending articles, open clusters (number, first day or null, day of forgetting or null, sets of tokens) and the next number."""

    def __init__(self, tolerance: int, retention: int):
        self.tolerance, self.retention = tolerance, retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "day int, pos long, tokens string")
        self.open = handle.getListState("open", "number int, first int, until int, sets string")
        self.size = handle.getValueState("size", "n int")

    def _load(self) -> tuple[list[list], int]:
        found = [[n, first, until, [frozenset(s.split()) for s in sets.split("|")]] for n, first, until, sets in self.open.get()] if self.open.exists() else []
        return found, self.size.get()[0] if self.size.exists() else 0

    def _store(self, clusters: list[list], size: int) -> None:
        rows = [(n, first, until, "|".join(" ".join(sorted(s)) for s in sets)) for n, first, until, sets in clusters]
        if rows:
            self.open.put(rows)
        else:
            self.open.clear()
        self.size.update((size,))

    def _placed(self, clusters: list[list], size: int, day: int | None, own: frozenset, until: int | None) -> tuple[int, int]:
        """The cluster of an article, and the next number."""
        for c in clusters:
            if (day is None or c[1] is None or 0 <= day - c[1] <= self.tolerance) and all(not own or not m or own & m for m in c[3]):
                break
        else:
            c = [size, None, until, []]
            clusters.append(c)
            size += 1
        if day is not None and c[1] is None:
            c[1], c[2] = day, None
        if own not in c[3]:
            c[3].append(own)
        return c[0], size

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["pos", "type", "country", "cluster", "late"]).astype({"cluster": "Int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = max(0, timerValues.getCurrentWatermarkInMs())
        out, waiting, undated = [], [], []
        for frame in rows:
            for pos, day, tokens in zip(frame["pos"], frame["day"], frame["tokens"]):
                if pd.isna(day):
                    undated.append((int(pos), frozenset(tokens.split())))
                elif (int(day) + 1) * DAY <= now:
                    out.append((pos, *key, None, True))
                else:
                    waiting.append((int(day), int(pos), tokens))
        if waiting:
            self.pending.appendList(waiting)
            for day in {w[0] for w in waiting}:
                self.handle.registerTimer((day + 1) * DAY)
        if undated:
            clusters, size = self._load()
            until = now // DAY + self.retention
            for pos, own in sorted(undated, key=lambda u: u[0]):
                number, size = self._placed(clusters, size, None, own, until)
                out.append((pos, *key, number, False))
            if any(c[2] == until for c in clusters):
                self.handle.registerTimer((until + 1) * DAY)
            self._store(clusters, size)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = expiredTimerInfo.getExpiryTimeInMs() // DAY - 1  # the last day that is over
        clusters, size = self._load()
        held = list(self.pending.get()) if self.pending.exists() else []
        ready, rest = sorted(h for h in held if h[0] <= closed), [h for h in held if h[0] > closed]
        out = []
        for day, pos, tokens in ready:
            number, size = self._placed(clusters, size, day, frozenset(tokens.split()), None)
            out.append((pos, *key, number, False))
        if ready:
            if rest:
                self.pending.put(rest)
            else:
                self.pending.clear()
        kept = [c for c in clusters if (c[1] >= closed + 1 - self.tolerance if c[1] is not None else c[2] > closed)]
        self._store(kept, size)
        if any(c[1] is not None for c in kept):  # to drop them when no article comes any more
            self.handle.registerTimer((min(c[1] for c in kept if c[1] is not None) + self.tolerance + 1) * DAY)
        yield self._frame(out)

    def close(self) -> None:
        pass


def stream_clusters(articles: DataFrame, lateness: str = "7 days", retention: int = 30, tolerance: int = TOLERANCE) -> DataFrame:
    """pos, type, country, cluster, late of each article of a stream (pos, label, country_iso2, event_date, location_text).

    An article is given out once the watermark (the newest date less the lateness) has passed its day; retention: days that a cluster without a date is kept.
    """
    spark = articles.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    day = F.col("event_date").cast("date")
    timed = articles.withColumn("__at", day.cast("timestamp")).withWatermark("__at", lateness)
    # The day is a plain number for the processor, which tells late articles itself; Spark would drop them.
    keyed = partition_keys(timed).select("pos", "type", "country", F.unix_date(day).alias("day"), F.array_join(F.array_sort(location_tokens(F.col("location_text"))), " ").alias("tokens"))
    return keyed.groupBy("type", "country").transformWithStateInPandas(Clusterer(tolerance, retention), OUT, "Append", "EventTime")
