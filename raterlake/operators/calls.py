"""Operational analytics of calls: shards, resuming, breakers, limits, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.operators import ranks


def micros(ts: str) -> Column:
    """Microseconds of a timestamp column, with or without a time zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def run_id(kind: str, started: Column, suffix: str = "") -> Column:
    """kind_yyyyMMdd_HHmmss of a run's start in the session's time zone, as run folders are named; ``suffix`` may follow."""
    return F.concat(F.lit(f"{kind}_"), F.date_format(started, "yyyyMMdd_HHmmss"), F.lit(f"_{suffix}" if suffix else ""))


def shard_plan(df: DataFrame, group: str, size: int) -> DataFrame:
    """(group, shard_id, start, end, count) of shards of ``size`` rows, from the groups' counts alone."""
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    shards = n.select(group, "n", F.explode(F.expr(f"sequence(1, cast(ceil(n / {size}D) as int))")).alias("shard_id"))
    start = ((F.col("shard_id") - 1) * size).cast("long")
    return shards.select(group, F.col("shard_id").cast("long").alias("shard_id"), start.alias("start"), F.least(start + size, "n").alias("end")).withColumn("count", F.col("end") - F.col("start"))


def remaining(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items that are not done."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def dry_run(work: DataFrame, done: DataFrame, keys: Sequence[str], group: str, raters: int) -> DataFrame:
    """(group, total, remaining, calls): calls to make are the remaining items for each rater."""
    marked = work.join(done.select(*keys).distinct().withColumn("_done", F.lit(1)), list(keys), "left")
    return marked.groupBy(group).agg(F.count("*").alias("total"), F.count_if(F.col("_done").isNull()).alias("remaining")).withColumn("calls", F.col("remaining") * raters)


def dry_run_shards(work: DataFrame, done: DataFrame, keys: Sequence[str], group: str, order: str, size: int, raters: int) -> DataFrame:
    """(group, shard_id, start, end, count, remaining, calls): the shards of ``size`` items by ``order`` that a run would go through, and what is left to do in each."""
    marked = work.join(done.select(*keys).distinct().withColumn("_done", F.lit(1)), list(keys), "left")
    placed = ranks.numbered(marked, [group], order, "_row").withColumn("shard_id", F.ceil(F.col("_row") / size).cast("long"))
    agg = placed.groupBy(group, "shard_id").agg(F.count("*").alias("count"), F.count_if(F.col("_done").isNull()).alias("remaining"))
    start = (F.col("shard_id") - 1) * size
    return agg.select(group, "shard_id", start.alias("start"), (start + F.col("count")).alias("end"), "count", "remaining", (F.col("remaining") * raters).alias("calls"))


def breaker_trips(df: DataFrame, group: str, order: str, failed: str, limit: int = 5) -> DataFrame:
    """(group, tripped_at, run_length): where a group's run of failures first reaches ``limit``, and its longest run; successes reset it.

    Runs are counted in buckets of the order. What a bucket ends with is carried to
    the next ones by a window over the buckets alone.
    """
    rows = ranks.bucketed(df.select(F.struct(group).alias("_g"), F.col(order).alias("_o"), F.col(failed).alias("_f")), "_o")
    inside = Window.partitionBy("_g", "_bucket").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("_run", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(inside))
    within = Window.partitionBy("_g", "_bucket", "_run").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    counted = runs.withColumn("_length", F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(within)).withColumn("_resets", F.max("_run").over(Window.partitionBy("_g", "_bucket")))
    tails = counted.groupBy("_g", "_bucket").agg(F.count_if(F.col("_f") & (F.col("_run") == F.col("_resets"))).alias("_tail"), (F.max("_resets") > 0).alias("_reset"))
    over = Window.partitionBy("_g").orderBy("_bucket")
    islands = tails.withColumn("_island", F.sum(F.col("_reset").cast("int")).over(over))
    carried = islands.withColumn("_out", F.sum("_tail").over(Window.partitionBy("_g", "_island").orderBy("_bucket"))).withColumn("_in", F.coalesce(F.lag("_out").over(over), F.lit(0)))
    length = F.col("_length") + F.when(F.col("_run") == 0, F.col("_in")).otherwise(0)
    full = counted.join(carried.select("_g", "_bucket", "_in"), ["_g", "_bucket"]).withColumn("_length", length).where((F.col("_length") >= limit) & F.col("_f"))
    return full.groupBy(f"_g.{group}").agg(F.min("_o").alias("tripped_at"), F.max("_length").alias("run_length"))


#: Windows of a time bucket in rate_audit.
WINDOWS = 60


def rate_audit(df: DataFrame, group: str, ts: str, seconds: int = 60) -> DataFrame:
    """(group, most_in_window, least_gap_s): the most calls in any window of ``seconds`` up to a call, and the least gap between calls.

    Calls are counted in time buckets of WINDOWS windows, to which the last window of
    the bucket before is added. Gaps between buckets come from their first and last calls.
    """
    span = seconds * 1_000_000
    stamped = df.select(group, micros(ts).alias("_t")).where("_t is not null").withColumn("_bucket", F.floor(F.col("_t") / (span * WINDOWS)))
    late = F.col("_t") >= (F.col("_bucket") + 1) * (span * WINDOWS) - span
    copies = F.when(late, F.array(F.struct(F.col("_bucket").alias("b"), F.lit(True).alias("own")), F.struct((F.col("_bucket") + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(True).alias("own"))))
    rows = stamped.select(group, "_t", F.explode(copies).alias("c")).select(group, "_t", "c.b", "c.own")
    w = Window.partitionBy(group, "b").orderBy("_t")
    counted = rows.withColumn("_n", F.count("*").over(w.rangeBetween(-span, 0))).withColumn("_gap", F.col("_t") - F.lag("_t").over(w)).where("own")
    per = counted.groupBy(group, "b").agg(F.max("_n").alias("_n"), F.min("_gap").alias("_gap"), F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    gap = F.col("_first") - F.lag("_last").over(Window.partitionBy(group).orderBy("b"))
    return per.withColumn("_gap", F.least("_gap", gap)).groupBy(group).agg(F.max("_n").alias("most_in_window"), (F.min("_gap") / 1e6).alias("least_gap_s"))


def progress_marks(df: DataFrame, group: str, order: str, every: int) -> DataFrame:
    """Every ``every``-th row of a group, with its number from 1."""
    return ranks.numbered(df, [group], order, "done").where(F.col("done") % every == 0)


def final_attempts(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last attempt of each call and how many there were; one aggregate."""
    others = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_last"), F.count("*").alias("attempts"))
    return last.select(*keys, *(F.col("_last")[c].alias(c) for c in others), "attempts")


def throughput(df: DataFrame, group: Sequence[str], ts: str, total: int) -> DataFrame:
    """(group, done, elapsed_s, per_minute, remaining, eta_s) against ``total`` items a group."""
    agg = df.groupBy(*group).agg(F.count("*").alias("done"), ((F.max(micros(ts)) - F.min(micros(ts))) / 1e6).alias("elapsed_s"))
    rate = F.when(F.col("elapsed_s") > 0, F.col("done") * 60.0 / F.col("elapsed_s"))
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    return agg.withColumns({"per_minute": rate, "remaining": left}).withColumn("eta_s", F.col("remaining") * 60.0 / F.col("per_minute"))


def run_totals(df: DataFrame, group: str, failed: str) -> DataFrame:
    """(group, completed, failed, total, succeeded, total_as_counted): the last counts failures among the completed and again, as some run reports do."""
    agg = df.groupBy(group).agg(F.count("*").alias("completed"), F.count_if(F.col(failed)).alias("failed"))
    return agg.withColumns({"total": F.col("completed"), "succeeded": F.col("completed") - F.col("failed"), "total_as_counted": F.col("completed") + F.col("failed")})


def run_manifest(df: DataFrame, group: str, failed: str, ts: str, *more: Column) -> DataFrame:
    """run_totals() with the first and last time of each run, the seconds between, and ``more`` aggregates. One pass; a null run is a run."""
    agg = df.groupBy(group).agg(F.count("*").alias("completed"), F.count_if(F.col(failed)).alias("failed"), F.min(ts).alias("started"), F.max(ts).alias("ended"), ((F.max(micros(ts)) - F.min(micros(ts))) / 1e6).alias("elapsed_s"), *more)
    return agg.withColumns({"total": F.col("completed"), "succeeded": F.col("completed") - F.col("failed"), "total_as_counted": F.col("completed") + F.col("failed")})


def speed_report(calls: DataFrame, group: str, latency: str) -> DataFrame:
    """(group, calls, avg_latency_ms, total_s): calls without a latency count as calls; the total is calls times the mean, null without any latency."""
    agg = calls.groupBy(group).agg(F.count("*").alias("calls"), F.avg(F.col(latency).try_cast("double")).alias("avg_latency_ms"))
    return agg.withColumn("total_s", F.col("calls") * F.col("avg_latency_ms") / 1000)


def shard_rows(df: DataFrame, group: str, order: str, size: int, shard: int) -> DataFrame:
    """The rows of one shard (from 1) of each group, with shard_id."""
    return ranks.numbered(df, [group], order, "_row").withColumn("shard_id", F.ceil(F.col("_row") / size).cast("long")).where(F.col("shard_id") == shard).drop("_row")


def ready(engines: DataFrame, group: str, is_ready: Column, passed: Column, least: int = 2) -> DataFrame:
    """(ready_count, ready_engines, consensus_ready): engines that are ready and passed, and whether they are enough for a vote."""
    ok = engines.where(is_ready & passed).select(group).distinct().agg(F.count("*").alias("ready_count"), F.concat_ws(",", F.array_sort(F.collect_list(group))).alias("ready_engines"))  # engines are few
    return ok.withColumn("consensus_ready", F.col("ready_count") >= least)
