"""Progress that comes from the pass that writes: observed counts, a log that grows, a summary that is replaced."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from raterlake.sources import atomic

#: Name of the metrics that a watched stream reports.
WATCHED = "progress"


def metrics(failed: Column | None = None, latency: str | None = None) -> list[Column]:
    """rows, failed and latency_s of what passes by; all of them sums, so they need no exchange."""
    fails = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    spent = F.col(latency).try_cast("double") / 1000 if latency else F.lit(0.0)
    return [F.count(F.lit(1)).alias("rows"), F.count_if(fails).alias("failed"), F.coalesce(F.sum(spent), F.lit(0.0)).alias("latency_s")]


class ProgressLog:
    """Entries below ``folder``: log/, one JSON file an entry (read as a table by entries()), and summary.json, the last one."""

    def __init__(self, spark: SparkSession, folder: str, total: int, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.total, self.clock = spark, folder.rstrip("/"), total, clock
        self.started = clock()

    def summary(self) -> dict | None:
        """The last entry."""
        text = atomic.read_text(self.spark, f"{self.folder}/summary.json")
        return json.loads(text) if text else None

    def entries(self) -> DataFrame:
        """All entries, by time."""
        return self.spark.read.json(f"{self.folder}/log").orderBy("updated_at")

    def add(self, rows: int, failed: int = 0, latency_s: float = 0.0) -> dict:
        """Counts ``rows`` more; done, percent, rate a minute and seconds left follow, going on from the summary that is there."""
        before = self.summary() or {"completed": 0, "failed": 0, "latency_s": 0.0, "elapsed_s": 0.0}
        now = self.clock()
        elapsed, self.started = before["elapsed_s"] + now - self.started, now
        done = before["completed"] + rows
        rate = done / elapsed if elapsed > 0 else 0.0
        entry = {
            "completed": done,
            "failed": before["failed"] + failed,
            "total": self.total,
            "percent": round(100 * done / self.total, 1) if self.total > 0 else 0.0,
            "elapsed_s": round(elapsed, 3),
            "rate_per_min": round(60 * rate, 2),
            "eta_remaining_s": round((self.total - done) / rate, 1) if rate > 0 else 0.0,
            "latency_s": round(before["latency_s"] + latency_s, 3),
            "updated_at": datetime.fromtimestamp(now, UTC).isoformat(),
        }
        text = json.dumps(entry)
        atomic.write_text(self.spark, f"{self.folder}/log/{int(now * 1000):015d}-{uuid.uuid4().hex[:8]}.json", text)
        atomic.write_text(self.spark, f"{self.folder}/summary.json", text)
        return entry

    def write(self, df: DataFrame, write: Callable[[DataFrame], None], failed: Column | None = None, latency: str | None = None) -> dict:
        """Runs ``write`` on ``df``, whose rows are counted as they are written, and adds an entry. A write that fails adds none."""
        seen = Observation()
        write(df.observe(seen, *metrics(failed, latency)))
        return self.add(**seen.get)

    def listener(self, query: str | None = None) -> StreamingQueryListener:
        """For spark.streams.addListener(): an entry for each batch of a stream watched() (of the one named ``query``)."""
        return _Listener(self, query)


class _Listener(StreamingQueryListener):
    def __init__(self, log: ProgressLog, query: str | None):
        self.log, self.query = log, query

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress
        found = told.observedMetrics.get(WATCHED) if self.query in (None, told.name) else None
        if found is not None and found["rows"]:
            self.log.add(found["rows"], found["failed"], found["latency_s"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watched(stream: DataFrame, failed: Column | None = None, latency: str | None = None) -> DataFrame:
    """``stream``, its rows being counted for a listener as they pass."""
    return stream.observe(WATCHED, *metrics(failed, latency))
