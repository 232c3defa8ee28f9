"""Writing intermediate tables where every executor can read them, and joins that stand hot keys."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlake.session import ship

#: Spark deletes the shuffle files of a query as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that were written and not yet deleted: path -> Hadoop's path and file system.
_written: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Where neither is set, a session on one machine (tests) gets a temporary
    folder; on a cluster that is an error, as executors could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "raterlake-checkpoints"))
    return context.getCheckpointDir().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: whatever follows re-reads the files, so the loss of
    an executor never repeats the work above. The files go with drop(), or when
    the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/raterlake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")  # the written table is what is read again, so its shuffles can go
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._raterlake_path = path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    _written[path] = (hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration()))
    return back


def drop(*tables: DataFrame) -> None:
    """Delete the files of settled tables that no later plan reads."""
    for df in tables:
        found = _written.pop(getattr(df, "_raterlake_path", None), None)
        if found:
            found[1].delete(found[0], True)


@atexit.register
def _delete_all() -> None:
    for hadoop, files in _written.values():
        try:
            files.delete(hadoop, True)
        except Exception:  # the JVM has gone already
            return


#: Keys that hold more than one in so many rows of a table, and more than so many rows, are joined by a broadcast.
HEAVY, HEAVY_ROWS = 10_000, 1_000


def with_groups(rows: DataFrame, keys: list[str], having: str = "true", **aggregates: Column) -> DataFrame:
    """``rows`` and their group's ``aggregates`` as columns, groups being rows of equal ``keys`` (not null); ``having`` may use the aggregates and _n, the group's rows.

    The aggregates are pre-aggregated before the shuffle; see attached() for how
    they come back to the rows. ``rows`` is gone through several times and should be
    a settled table, or cheap.
    """
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(c.alias(name) for name, c in aggregates.items())).where(having)
    return attached(rows, groups, keys).drop("_n")


def attached(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with the one row that ``groups`` has for their ``keys``; _n of ``groups`` says how many rows that are.

    Groups of more than a HEAVY-th of all rows, of which there are fewer than HEAVY,
    are sent to every task, so a group of a third of all rows is dealt over as many
    tasks as its rows come from; the other groups are joined by a shuffle.
    """
    n = rows.count()
    bound = max(HEAVY_ROWS, n // HEAVY)
    if n <= bound:
        return rows.join(groups, keys)
    heavy = F.broadcast(groups.where(F.col("_n") > bound))
    light = rows.join(heavy.select(*keys), keys, "left_anti").join(groups.where(F.col("_n") <= bound), keys)
    return rows.join(heavy, keys).unionByName(light)


#: Ids of so many documents are sent to every task at most (some tens of MB).
BROADCAST_IDS = 2_000_000


def keep_ids(rows: DataFrame, ids: DataFrame, how: str, key: str = "id") -> DataFrame:
    """``rows`` whose ``key`` is in ``ids`` (``how`` left_semi) or isn't (left_anti); ``ids`` (``key``, each once) goes to every task if it has few enough rows, else both are shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def small_batches(spark: SparkSession) -> None:
    """Before Python work: the package goes to the workers, and Arrow batches get smaller. Batches have at most 1,000 rows: whole texts travel in them, and the default of 10,000 long texts would not fit a worker."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
