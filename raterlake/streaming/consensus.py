"""Consensus over answers that keep arriving.

The panel is kept in buckets of its units. A batch reads the buckets of the units it
touches, merges, votes, and writes them anew under its own number; a commit file that says which
batch holds each bucket is put in place last. Until then readers see the buckets
as they were, a batch that died is written again over its leftovers, and one that is
committed and comes again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterlake.operators import panel
from raterlake.sources import atomic

#: How rows are dealt to buckets. Spark's repartition() deals by the same hash, so a task that has one of a multiple of ``buckets`` partitions has rows of one bucket.
DEALT = "hash"
_OBJECTS = "spark.sql.execution.useObjectHashAggregateExec"
#: Commits that stay readable, so that a reader of the last one isn't disturbed by the next.
KEPT = 2


class ConsensusTable:
    """Rows (one a unit and rater, the first in order) and votes of a panel below ``folder``.

    ``schema`` is that of the answers: ``unit``, ``rater``, the ``dims`` and the ``order`` columns;
    other columns are kept beside. A blank unit is left out, as in the batch readers. The result is
    that of panel.dedup() and panel.consensus() over all answers so far, whatever their
    order of arrival.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, unit: str, rater: str, dims: Sequence[str], order: Sequence[str], buckets: int = 64, min_raters: int = 2, full_panel: int = 4):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), T._parse_datatype_string(schema)
        self.unit, self.rater, self.dims, self.order, self.buckets = unit, rater, list(dims), list(order), buckets
        self.least, self.full = min_raters, full_panel

    def _commits(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in atomic.names(self.spark, f"{self.folder}/commits") if n.endswith(".json"))

    def _state(self, batch: int) -> dict:
        return json.loads(atomic.read_text(self.spark, f"{self.folder}/commits/{batch:020d}.json"))

    def _commit(self, batch: int | None) -> dict[int, int]:
        """bucket -> the batch that wrote it last, as of a commit."""
        return {} if batch is None else {int(b): n for b, n in self._state(batch)["buckets"].items()}

    def _read(self, what: str, held: dict[int, int], schema: T.StructType) -> DataFrame:
        paths = [f"{self.folder}/{what}/batch={n}/bucket={b}" for b, n in held.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """The deduplicated panel as of the last commit."""
        return self._read("rows", self._commit(next(reversed(self._commits()), None)), self.schema)

    def votes(self) -> DataFrame:
        """panel.consensus() as of the last commit."""
        empty = self._voted(self.spark.createDataFrame([], self.schema)).schema
        return self._read("votes", self._commit(next(reversed(self._commits()), None)), empty)

    def _voted(self, rows: DataFrame) -> DataFrame:
        return panel.consensus(rows, self.unit, self.dims, self.order, self.least, self.full)

    def _bucket(self) -> F.Column:
        return F.pmod(F.hash(self.unit), F.lit(self.buckets)).cast("int").alias("bucket")

    def _written(self, folder: str) -> list[int]:
        return sorted(int(n.removeprefix("bucket=")) for n in atomic.names(self.spark, folder) if n.startswith("bucket="))

    def merge(self, answers: DataFrame, batch: int) -> list[int]:
        """Takes in a batch; returns the buckets it wrote anew. For foreachBatch: ``lambda df, n: table.merge(df, n)``.

        Both tables are written by tasks of one bucket and some panel.TASK_ROWS rows each, so the
        files are as many as these tasks, not tasks times buckets, and what a task holds doesn't grow.
        """
        commits = self._commits()
        if commits and batch <= commits[-1]:
            return []  # committed before
        held = self._commit(commits[-1] if commits else None)
        moved = bool(held) and self._state(commits[-1]).get("dealt") != DEALT  # an older table is dealt anew
        new = answers.select(*self.schema.names).where(F.trim(F.coalesce(F.col(self.unit).cast("string"), F.lit(""))) != "")
        counts = {r["bucket"]: r["count"] for r in new.groupBy(self._bucket()).count().collect()}  # no more than there are buckets
        touched = sorted(counts)
        if touched:
            old = self._read("rows", {b: n for b, n in held.items() if moved or b in counts}, self.schema)
            rows = sum(counts.values()) + old.count()
            rows_at, votes_at = (f"{self.folder}/{what}/batch={batch}" for what in ("rows", "votes"))
            dealt = lambda df: panel.clustered(df, self.unit, rows, self.buckets)
            merged = panel.dedup(dealt(old.unionByName(new)), [self.unit, self.rater], self.order)
            merged.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(rows_at)
            touched = self._written(rows_at)
            voted = self._voted(dealt(self._read("rows", dict.fromkeys(touched, batch), self.schema)))
            before = self.spark.conf.get(_OBJECTS)
            self.spark.conf.set(_OBJECTS, "false")  # rows come sorted by unit, so sets of labels need no map of objects
            try:
                voted.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(votes_at)
            finally:
                self.spark.conf.set(_OBJECTS, before)
            none = self.spark.createDataFrame([], voted.schema)
            for b in sorted(set(touched) - set(self._written(votes_at))):  # no unit of it has enough raters yet
                none.write.mode("overwrite").parquet(f"{votes_at}/bucket={b}")
            held = {} if moved else held
        held.update(dict.fromkeys(touched, batch))
        state = {"buckets": held} if moved and not touched else {"buckets": held, "dealt": DEALT}
        atomic.write_text(self.spark, f"{self.folder}/commits/{batch:020d}.json", json.dumps(state))
        self._forget()
        return touched

    def _forget(self) -> None:
        """Deletes commits before the last KEPT ones, and bucket folders that none of these name."""
        commits = self._commits()
        named = {(b, n) for c in commits[-KEPT:] for b, n in self._commit(c).items()}
        for what in ("rows", "votes"):
            for folder in atomic.names(self.spark, f"{self.folder}/{what}"):
                n = int(folder.removeprefix("batch="))
                own = {b for b, m in named if m == n}
                if not own:
                    atomic.delete(self.spark, f"{self.folder}/{what}/{folder}")
                    continue
                for part in atomic.names(self.spark, f"{self.folder}/{what}/{folder}"):
                    if part.startswith("bucket=") and int(part.removeprefix("bucket=")) not in own:
                        atomic.delete(self.spark, f"{self.folder}/{what}/{folder}/{part}")
        for c in commits[:-KEPT]:
            atomic.delete(self.spark, f"{self.folder}/commits/{c:020d}.json")

    def follow(self, stream: DataFrame, checkpoint: str):
        """Merges everything that has arrived so far; a restart goes on from the checkpoint."""
        query = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
