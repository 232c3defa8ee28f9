"""Votes of a rater panel: deduplication, consensus, ties.

A panel is a table of one row a unit and rater; ``order`` columns give the row
order that ties go by. All operators here cluster by unit once, so a vote costs
one shuffle, and keep only aggregates of a unit, never its rows in a list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task gets, on average, where the rows of a unit are brought together.
TASK_ROWS = 500_000


def clustered(df: DataFrame, unit: str, rows: int | None = None, multiple: int = 1) -> DataFrame:
    """``df`` with all rows of a unit in one partition, which what follows reuses.

    The number of partitions (a multiple of ``multiple``) grows with ``rows``, those of
    ``df`` if not given, and adaptive execution leaves it as it is; so what a task holds
    doesn't grow with the table. Without a number, partitions are joined up to
    some 64 compressed MB, which are four million short rows or more.
    """
    rows = df.count() if rows is None else rows
    n = max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(multiple * -(-n // multiple), unit)


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: str = "first", valid: Column | None = None) -> DataFrame:
    """One row a key: the first or last in order, or with ``keep='valid'`` the first valid one (the first if none is). Blank keys stay."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    if keep == "last":
        by = [c.desc() for c in by]
    elif keep == "valid":
        by = [F.when(valid, 0).otherwise(1), *by]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def tally(df: DataFrame, unit: str, dims: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(unit, dim, label, c, first): votes of each label and the order of its first; blank labels count under null."""
    pairs = ", ".join(f"'{d}', nullif({d}, '')" for d in dims)
    long = df.select(unit, F.struct(*order).alias("ord"), F.expr(f"stack({len(dims)}, {pairs}) as (dim, label)"))
    return long.groupBy(unit, "dim", "label").agg(F.count("*").alias("c"), F.min("ord").alias("first"))


def dimension_votes(df: DataFrame, unit: str, dims: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(unit, dim, raters, total, winner, agreement, candidates): the most frequent label, ties to the first seen; candidates are all labels with that many votes."""
    t = tally(df, unit, dims, order)
    real = F.col("label").isNotNull()
    top = F.min(F.when(real, F.struct((-F.col("c")).alias("n"), "first", "label")))
    votes = t.groupBy(unit, "dim").agg(
        F.sum("c").alias("raters"),
        F.coalesce(F.sum(F.when(real, F.col("c"))), F.lit(0)).alias("total"),
        top.alias("top"),
        F.collect_set(F.when(real, F.struct("label", "c"))).alias("all"),  # at most one entry a label
    )
    agreement = F.coalesce(-F.col("top.n"), F.lit(0))
    candidates = F.array_sort(F.transform(F.filter("all", lambda x: x["c"] == agreement), lambda x: x["label"]))
    return votes.select(unit, "dim", "raters", "total", F.coalesce("top.label", F.lit("")).alias("winner"), agreement.alias("agreement"), candidates.alias("candidates"))


def consensus(df: DataFrame, unit: str, dims: Sequence[str], order: Sequence[str], min_raters: int = 2, full_panel: int = 4) -> DataFrame:
    """One row a unit with at least ``min_raters`` rows.

    n_engines; per dimension D, D_agreement, D_total (0 if all are blank); consensus:
    high if the panel is full and every dimension unanimous among its non-blank
    votes, medium if the least agreement ratio is 0.75 or more, else review. After
    the documented rule consensus_level is high if every top count fills the panel,
    medium if all are 2 or more, else low; consensus_count is the number of
    dimensions with 2 or more; any_tie_flag and tie_dimensions name the ties, and
    consensus_status says whether there was one.
    """
    v = dimension_votes(df, unit, dims, order)
    ratio = F.when(F.col("total") > 0, F.col("agreement") / F.col("total"))
    whole = (F.col("winner") != "") & (F.col("agreement") == F.col("total"))
    tie = F.size("candidates") > 1
    columns = [F.max("raters").alias("n_engines"), F.min(ratio).alias("min_ratio"), F.bool_and(whole).alias("unanimous"), F.min("agreement").alias("least"), F.count_if(F.col("agreement") >= 2).alias("consensus_count"), F.array_sort(F.collect_set(F.when(tie, F.col("dim")))).alias("ties")]
    for d in dims:
        own = F.col("dim") == d
        columns += [F.max(F.when(own, F.col("winner"))).alias(d), F.max(F.when(own, F.col("agreement"))).alias(f"{d}_agreement"), F.max(F.when(own, F.col("total"))).alias(f"{d}_total")]
    u = v.groupBy(unit).agg(*columns).where(F.col("n_engines") >= min_raters)
    tier = F.when((F.col("n_engines") >= full_panel) & F.col("unanimous"), "high").when(F.coalesce("min_ratio", F.lit(0.0)) >= 0.75, "medium").otherwise("review")
    level = F.when(F.col("least") >= full_panel, "high").when(F.col("least") >= 2, "medium").otherwise("low")
    return u.select(
        unit, "n_engines", *(c for d in dims for c in (d, f"{d}_agreement", f"{d}_total")), tier.alias("consensus"), level.alias("consensus_level"), "consensus_count",
        (F.size("ties") > 0).alias("any_tie_flag"), F.concat_ws(",", "ties").alias("tie_dimensions"), F.when(F.size("ties") > 0, "resolved_with_tie").otherwise("resolved_no_tie").alias("consensus_status"),
    )


def tie_metadata(df: DataFrame, unit: str, dims: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(unit, dim, tie_flag, top_vote_count, num_valid_votes, candidate_values) of each dimension."""
    v = dimension_votes(df, unit, dims, order)
    return v.select(unit, "dim", (F.size("candidates") > 1).alias("tie_flag"), F.col("agreement").alias("top_vote_count"), F.col("total").alias("num_valid_votes"), F.concat_ws("|", "candidates").alias("candidate_values"))


def unique_labels_per_unit(df: DataFrame, unit: str, dim: str) -> DataFrame:
    """Mean number of distinct non-blank labels a unit has (units without any don't count)."""
    per = df.where(F.coalesce(F.col(dim), F.lit("")) != "").groupBy(unit).agg(F.countDistinct(dim).alias("n"))
    return per.agg(F.sum("n").alias("labels"), F.count("*").alias("units"), F.avg("n").alias("mean_labels"))


def independent_counts(df: DataFrame, columns: Sequence[str], total: bool = False) -> DataFrame:
    """(kind, value, n): counts by each column on its own, and in all, from one pass (grouping sets)."""
    sets = [[c] for c in columns] + ([[]] if total else [])
    grouped = df.groupingSets(sets, *columns).agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"_{c}") for c in columns))
    own = [(F.col(f"_{c}") == 0, c) for c in columns]
    kind, value = F.lit("all"), F.lit("")
    for is_set, c in own:
        kind, value = F.when(is_set, c).otherwise(kind), F.when(is_set, F.col(c).cast("string")).otherwise(value)
    return grouped.select(kind.alias("kind"), value.alias("value"), "n")


def bucket_index(votes: DataFrame, columns: Sequence[str], labels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(bucket_kind, bucket, n): independent counts by each column; each of a column's ``labels`` has a row, be it of 0."""
    counted = independent_counts(votes, columns).toDF("bucket_kind", "bucket", "n")
    known = [(c, x) for c, values in (labels or {}).items() for x in values]
    if not known:
        return counted
    empty = votes.sparkSession.createDataFrame([(c, x, 0) for c, x in known], "bucket_kind string, bucket string, n long")
    return counted.unionByName(empty).groupBy("bucket_kind", "bucket").agg(F.sum("n").alias("n"))


def bucket_manifest(members: DataFrame, unit: str, labels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(bucket, n, first_unit, last_unit) of a bucket export, empty buckets of the ``labels`` included."""
    counted = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(unit).alias("first_unit"), F.max(unit).alias("last_unit"))
    names = [(f"{c}/{x}",) for c, values in (labels or {}).items() for x in values]
    if not names:
        return counted
    every = F.broadcast(members.sparkSession.createDataFrame(names, "bucket string"))
    return every.join(counted, "bucket", "left").unionByName(counted.join(every, "bucket", "left_anti")).withColumn("n", F.coalesce("n", F.lit(0)))


def bucket_members(votes: DataFrame, unit: str, columns: Sequence[str], skip: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(bucket, unit): each unit's bucket by each column, without blank values and those to skip."""
    pairs = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in columns))
    rows = votes.select(F.col(unit), F.explode(pairs).alias("b")).select(unit, "b.kind", "b.value").where("coalesce(value, '') <> ''")
    for c, values in (skip or {}).items():
        rows = rows.where((F.col("kind") != c) | ~F.col("value").isin(list(values)))
    return rows.select(F.concat_ws("/", "kind", "value").alias("bucket"), unit)
