"""Incremental ingest: answers that arrive in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_arriving(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(folder)


def first_answers(stream: DataFrame, keys: list[str], ts: str, lateness: str = "1 day") -> DataFrame:
    """One row a key within the lateness that a rerun may have; older repeats are for the table's own dedup."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def append_once(stream: DataFrame, table: str, checkpoint: str):
    """Everything that has arrived so far, into a Parquet table, exactly once; a restart resumes from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(stream: DataFrame, ts: str, group: str, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Tumbling event-time counts (an extension: the batch operators have no event time)."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, window), group).agg(F.count("*").alias("n")).select("window.start", "window.end", group, "n")


def breaker_state(limit: int = 5, ttl_ms: int = 86_400_000):
    """State function: a group's run of failures across batches; a row when it reaches ``limit``. The calls of a batch count in the order of their times, whatever frames they come in; when the watermark is ``ttl_ms`` past the last one the state goes."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            (run,) = state.get if state.exists else (0,)
            arrived = pd.concat([f[["ts", "failed"]] for f in frames]).sort_values("ts", kind="stable")  # a batch's calls of one rater
            for ts, failed in arrived.itertuples(index=False):
                run = run + 1 if failed else 0
                if run == limit:
                    out.append((key[0], ts, run))
            state.update((run,))
            last = int(arrived["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame(out, columns=["rater", "tripped_at", "run_length"])

    return step


def breaker_stream(stream: DataFrame, limit: int = 5, ttl_ms: int = 86_400_000, lateness: str = "1 hour") -> DataFrame:
    """(rater, tripped_at, run_length) from a stream of (rater, ts, failed). For order across batches and further events see calls.call_events()."""
    return stream.withWatermark("ts", lateness).groupBy("rater").applyInPandasWithState(breaker_state(limit, ttl_ms), "rater string, tripped_at timestamp, run_length long", "run long", "append", GroupStateTimeout.EventTimeTimeout)
