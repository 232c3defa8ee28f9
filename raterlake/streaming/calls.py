"""Calls as they happen: runs of failures, attempts and final errors of each rater, with timers.

A rater's calls are put in order of their event time before they count: they are held until
the watermark has passed them, and a timer then lets them go. Calls later than the
watermark are dropped by Spark and counted nowhere. A rater of whom nothing is heard for a while is
forgotten, by a timer too, so state doesn't grow with the raters there ever were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from raterlake.session import ship

#: What a stream of calls tells.
EVENTS = "rater string, event string, at timestamp, item string, n long"
#: Status codes after which no call of the rater is of use.
FINAL = (401, 402, 404)


class CallMonitor(StatefulProcessor):
    """Events of one rater: ``tripped`` when a run of failures reaches ``limit`` (n: its length), ``gave_up`` when an item's failures reach ``attempts`` (n: how many), ``stopped`` at a final status (n: the status), after which nothing of the rater counts until it is forgotten, and ``forgotten`` (n: its calls)."""

    def __init__(self, limit: int = 5, attempts: int = 4, ttl_ms: int = 3_600_000, final: tuple[int, ...] = FINAL):
        self.limit, self.attempts, self.ttl, self.final = limit, attempts, ttl_ms, tuple(final)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "length long, calls long, stopped boolean, last long")
        self.tries = handle.getMapState("tries", "item string", "n long")
        self.waiting = handle.getListState("waiting", "at long, item string, failed boolean, status int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, now = [], timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for at, item, failed, status in frame[["at", "item", "failed", "status"]].itertuples(index=False):
                if at >= now:  # Spark drops what is late by the watermark of the batch before only
                    held.append((int(at), str(item), bool(failed), int(status)))
        if held:
            self.waiting.appendList(held)
            self.handle.registerTimer(max(at for at, *_ in held))
        yield from self._let_go(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._let_go(key, timerValues)

    def _let_go(self, key, timers) -> Iterator[pd.DataFrame]:
        now, out = timers.getCurrentWatermarkInMs(), []
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in held if r[0] <= now]
        length, calls, stopped, last = tuple(self.run.get()) if self.run.exists() else (0, 0, False, 0)
        def forget() -> None:
            nonlocal length, calls, stopped
            out.append(("forgotten", last + self.ttl, None, calls))
            length, calls, stopped = 0, 0, False
            self.tries.clear()

        for at, item, failed, status in ready:
            if calls and at > last + self.ttl:
                forget()
            calls, last = calls + 1, at
            if stopped:
                continue
            length = length + 1 if failed else 0
            if length == self.limit:
                out.append(("tripped", at, item, length))
            if failed:
                n = (self.tries.getValue((item,))[0] if self.tries.containsKey((item,)) else 0) + 1
                self.tries.updateValue((item,), (n,))
                if n == self.attempts:
                    out.append(("gave_up", at, item, n))
                if status in self.final:
                    stopped = True
                    out.append(("stopped", at, item, status))
            elif self.tries.containsKey((item,)):
                self.tries.removeKey((item,))
        rest = held[len(ready) :]
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
            self.handle.registerTimer(last + self.ttl)
        if calls and now >= last + self.ttl:
            forget()
        if calls:
            self.run.update((length, calls, stopped, last))
        else:
            self.run.clear()
        text = lambda values: pd.Series(values, dtype=object)
        yield pd.DataFrame({"rater": text([key[0]] * len(out)), "event": text([e for e, *_ in out]), "at": pd.to_datetime(pd.Series([at for _, at, *_ in out], dtype="int64"), unit="ms"), "item": text([i for _, _, i, _ in out]), "n": pd.Series([n for *_, n in out], dtype="int64")})

    def close(self) -> None:
        pass


def call_events(stream: DataFrame, limit: int = 5, attempts: int = 4, lateness: str = "10 minutes", ttl_s: int = 3600, final: tuple[int, ...] = FINAL) -> DataFrame:
    """EVENTS of a stream of calls (rater, ts, item, failed, status).

    Calls of a rater that come out of order within ``lateness`` count in the order of their times
    (equal times: by item, successes first); later ones are dropped. ``ttl_s`` seconds of
    event time after a rater's last call its state goes. A null item, status or failure
    is blank, 0 and no failure; calls without a rater or time are left out. The session needs
    the RocksDB state store (rocksdb()).
    """
    ship(stream.sparkSession)
    sound = stream.where("rater is not null and ts is not null").withWatermark("ts", lateness)
    calls = sound.select("rater", "ts", F.unix_millis("ts").alias("at"), F.coalesce("item", F.lit("")).alias("item"), F.coalesce("failed", F.lit(False)).alias("failed"), F.coalesce("status", F.lit(0)).cast("int").alias("status"))
    return calls.groupBy("rater").transformWithStateInPandas(CallMonitor(limit, attempts, 1000 * ttl_s, final), EVENTS, "Append", "EventTime")


def rocksdb(spark: SparkSession) -> None:
    """The state store that state with several variables and timers needs; its state is on the executors' disks and in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
