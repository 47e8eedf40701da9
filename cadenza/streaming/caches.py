"""A cache with a time to live and session stores of bounded size, as keyed state of a stream.

State is kept for each key and store only; timers at the end of an entry's life take it away, so the state holds what is alive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cadenza.operators.scans import thin_by_gap

HOUR_MS = 3_600_000
LOOKUPS = "key string, at_ms bigint, hit boolean"
GONE = "store string, session string, last_ms bigint, reason string"
#: State store that keyed state with timers needs; set it on the session before such a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Cache(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "at_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.stored.get()[0] if self.stored.exists() else None
        times = sorted(t for batch in rows for t in batch["at_ms"])
        out = []
        for at in times:
            # An entry that lives exactly its time is still there.
            hit = stored is not None and at - stored <= self.ttl_ms
            if not hit:
                stored = at
            out.append((key[0], at, hit))
        if times:
            self.stored.update((stored,))
            self.handle.registerTimer(stored + self.ttl_ms + 1)
        yield pd.DataFrame(out, columns=["key", "at_ms", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A later entry has a timer of its own.
        if self.stored.exists() and expiredTimerInfo.getExpiryTimeInMs() - self.stored.get()[0] > self.ttl_ms:
            self.stored.clear()
        yield pd.DataFrame([], columns=["key", "at_ms", "hit"])

    def close(self) -> None:
        pass


def cached_lookups(lookups: DataFrame, ttl_ms: int = HOUR_MS, late: str = "10 minutes") -> DataFrame:
    """Each lookup (key, ts) of a stream with ``hit``: whether the key was stored at most ``ttl_ms`` before. A miss stores it, a hit does not renew it.

    Lookups of a key must come in the order of batches; within a batch they are taken by time. Event time drives the timers. Rows without key or time are left out.
    """
    timed = lookups.where("key is not null and ts is not null").withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    return timed.groupBy("key").transformWithStateInPandas(_Cache(ttl_ms), LOOKUPS, "Append", "EventTime")


def cache_hits(lookups: DataFrame, ttl_ms: int = HOUR_MS) -> DataFrame:
    """The batch twin: lookups (key, at_ms) with ``hit``. The misses are the times that lie more than ``ttl_ms`` behind the last miss; of equal times one is a miss."""
    known = lookups.where("key is not null and at_ms is not null")
    misses = thin_by_gap(known, ["key"], "at_ms", ttl_ms + 1, 24 * HOUR_MS).withColumn("_miss", F.lit(True))
    # Equal lookups fold into a count, of which one at most is a miss.
    counts = known.groupBy("key", "at_ms").agg(F.count("*").alias("n")).join(misses, ["key", "at_ms"], "left")
    return counts.select("key", "at_ms", F.col("n").alias("lookups"), (F.col("n") - F.when(F.col("_miss"), 1).otherwise(0)).alias("hits"))


class _Store(StatefulProcessor):
    def __init__(self, most: int, ttl_ms: int, sweep_ms: int):
        self.most, self.ttl_ms, self.sweep_ms = most, ttl_ms, sweep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState("sessions", "session string", "last_ms bigint, created bigint")
        self.swept = handle.getValueState("swept", "at_ms bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        live = {k[0]: tuple(v) for k, v in self.sessions.iterator()}
        swept, n = self.swept.get() if self.swept.exists() else (0, 0)
        before, gone = dict(live), []

        def sweep(now: int) -> None:
            old = [s for s, (last, _) in live.items() if self.ttl_ms > 0 and now - last > self.ttl_ms]
            gone.extend((key[0], s, live.pop(s)[0], "ttl") for s in old)
            # Of equal times the session that was made first goes.
            for s in sorted(live, key=lambda s: live[s])[: max(0, len(live) - self.most)]:
                gone.append((key[0], s, live.pop(s)[0], "lru"))

        uses = sorted((at, s) for batch in rows for at, s in zip(batch["at_ms"], batch["session"]))
        for at, session in uses:
            if self.sweep_ms <= 0 or at - swept >= self.sweep_ms:
                swept = at
                sweep(at)
            if session in live:
                live[session] = (at, live[session][1])
                continue
            n += 1
            live[session] = (at, n)
            if len(live) > self.most:
                sweep(at)
        for s in before.keys() - live.keys():
            self.sessions.removeKey((s,))
        for s, value in live.items():
            if before.get(s) != value:
                self.sessions.updateValue((s,), value)
        if uses:
            self.swept.update((swept, n))
        yield pd.DataFrame(gone, columns=["store", "session", "last_ms", "reason"])

    def close(self) -> None:
        pass


def evicted_stream(uses: DataFrame, most: int = 50, ttl_ms: int = 24 * HOUR_MS, sweep_ms: int = 60_000) -> DataFrame:
    """Sessions that go from their store as a stream of uses (store, session, ts) comes in: store, session, last_ms and reason (ttl or lru).

    At a use the store is swept if its last sweep is ``sweep_ms`` past: sessions idle for more than ``ttl_ms`` go, then the least recently used beyond ``most``. A new session
    beyond ``most`` sweeps at once. A store's state is its ``most`` sessions. Rows without store, session or time are left out; uses are taken by time within a batch.
    """
    known = uses.where("store is not null and session is not null and ts is not null").select("store", "session", F.unix_millis("ts").alias("at_ms"))
    return known.groupBy("store").transformWithStateInPandas(_Store(most, ttl_ms, sweep_ms), GONE, "Append", "None")
