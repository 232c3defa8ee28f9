"""Exact ranks, quantiles and row numbers without a window over a whole group.

Groups and orders may be null: a null group is a group as any other, and null
orders come first. Group keys travel as one struct, which is never null and equal
where all of its fields are equal or null, so plain equi-joins keep them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Approximate percentiles err by at most one in so many ranks; groups of fewer rows are sorted whole.
ACCURACY = 100_000
#: Rows of a bucket that one task sorts.
BUCKET_ROWS = 1_000_000
#: Statistics of so many groups, the largest ones, are sent to every task at most; a group beyond has less than one in so many rows.
BROADCAST_GROUPS = 10_000
#: Buckets of an order at most.
MOST_BUCKETS = 50_000


def attached(rows: DataFrame, stats: DataFrame, keys: Sequence[str], size: str = "n") -> DataFrame:
    """``rows`` joined with the row that ``stats`` has for their ``keys`` (null equals null); ``size`` of ``stats`` is the group's rows.

    The largest BROADCAST_GROUPS groups come to the driver and go to every task,
    so a group of a third of all rows stays where its rows are; only rows of
    groups beyond are shuffled.
    """
    spark, others = rows.sparkSession, [c for c in stats.columns if c not in keys]
    keyed = stats.select(F.struct(*keys).alias("_k"), *others)
    largest = keyed.orderBy(F.desc(size)).limit(BROADCAST_GROUPS + 1).collect()
    mine = rows.withColumn("_k", F.struct(*keys))
    heavy = F.broadcast(spark.createDataFrame(largest[:BROADCAST_GROUPS], keyed.schema))
    out = mine.join(heavy, "_k")
    if len(largest) > BROADCAST_GROUPS:
        named = heavy.select("_k")
        out = out.unionByName(mine.join(named, "_k", "left_anti").join(keyed.join(named, "_k", "left_anti"), "_k"))
    return out.drop("_k")


def values_at(df: DataFrame, group: Sequence[str], value: str, ranks: Mapping[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """(group, n, mean, one column a rank) of the non-null values of each group.

    A rank is a name with (share, f): f gives the rank, from 0, for a count of rows,
    and lies within a place or two of share * n. Two passes: approximate percentiles
    bound each rank's value, then rows below the bounds are counted, and only the values
    between them are ordered. Rows are counted by value before they meet, so no task gets a
    group's rows. Without values there is no row.
    """
    keys = list(group)
    v = df.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null")
    bounds = [(F.percentile_approx("v", max(0.0, share - 3 / ACCURACY), ACCURACY).alias(f"lo_{r}"), F.percentile_approx("v", min(1.0, share + 3 / ACCURACY), ACCURACY).alias(f"hi_{r}")) for r, (share, _) in ranks.items()]
    stats = v.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), *(b for pair in bounds for b in pair))
    if keys:
        joined = attached(v, stats, keys)
    else:
        one = stats.first()  # without groups that is one row
        joined = v.select("v", *(F.lit(one[c]).cast(stats.schema[c].dataType).alias(c) for c in stats.columns))
    small = F.col("n") <= ACCURACY

    def place(r: str) -> Column:
        return F.when(small, F.col("v")).when(F.col("v") < F.col(f"lo_{r}"), float("-inf")).when(F.col("v") <= F.col(f"hi_{r}"), F.col("v"))

    cells = F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), place(r).alias("at")) for r in ranks)))
    counted = joined.select(*keys, "n", "mean", cells.alias("c")).select(*keys, "n", "mean", "c.rank", "c.at").where("at is not null").groupBy(*keys, "rank", "at").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("mean").alias("mean"))
    upto = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "rank").orderBy("at")))
    picked = [F.min(F.when((F.col("rank") == r) & (F.col("upto") > f(F.col("n"))), F.col("at"))).alias(r) for r, (_, f) in ranks.items()]
    out = upto.groupBy(*keys).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), *picked)
    return out if keys else out.where("n is not null")


def quantiles(df: DataFrame, group: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """(group, q, value): linearly interpolated quantiles, exact."""
    ranks = {}
    for i, q in enumerate(levels):
        ranks[f"a{i}"] = (q, lambda n, q=q: F.floor((n - 1) * F.lit(q)))
        ranks[f"b{i}"] = (q, lambda n, q=q: F.ceil((n - 1) * F.lit(q)))
    at = values_at(df, group, value, ranks)

    def between(i: int, q: float) -> Column:
        place = (F.col("n") - 1) * F.lit(float(q))
        low, high = F.floor(place), F.ceil(place)
        return F.when(low == high, F.col(f"a{i}")).otherwise((high - place) * F.col(f"a{i}") + (place - low) * F.col(f"b{i}"))

    cells = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q"), between(i, q).alias("value")) for i, q in enumerate(levels))))
    return at.select(*group, cells.alias("c")).select(*group, "c.q", "c.value")


def bounds(df: DataFrame, order: str, rows: int | None = None) -> list[float]:
    """Values that cut ``df`` into buckets of about ``rows`` rows (BUCKET_ROWS) by ``order`` (a number or time), from a quantile sketch: the driver gets one number a bucket, MOST_BUCKETS at most.

    As they are quantiles, outliers leave the buckets even. Rows of one value stay together.
    """
    place = F.col(order).cast("double")
    parts = min(MOST_BUCKETS, math.ceil(df.where(place.isNotNull()).count() / (rows or BUCKET_ROWS)))
    if parts < 2:
        return []
    levels = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(place, levels, max(10_000, 20 * parts)).alias("b")).first()["b"]
    return sorted(set(found or []))


def bucket_of(place: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending ``cuts`` are not above ``place``; -1 for null. Two short scans: over the first cut of each slice, then over one slice."""
    if not cuts:
        return F.when(place.isNull(), -1).otherwise(0)
    at, step = place.cast("double"), math.isqrt(len(cuts) - 1) + 1
    slices = [list(cuts[i : i + step]) for i in range(0, len(cuts), step)]
    upto = lambda values: F.size(F.filter(values, lambda b: b <= at))
    k = upto(F.lit([s[0] for s in slices]))
    inside = F.element_at(F.array(*(F.lit(s) for s in slices)), F.greatest(k, F.lit(1)))
    return F.when(place.isNull(), -1).when(k == 0, 0).otherwise((k - 1) * step + upto(inside))


def bucketed(df: DataFrame, order: str, name: str = "_bucket") -> DataFrame:
    """Adds a bucket that rises with ``order``: of about BUCKET_ROWS rows, -1 for null. Buckets are those of the whole table, so the part of a group in one is no larger, and no join by group is needed."""
    return df.withColumn(name, bucket_of(F.col(order), bounds(df, order)))


def numbered(df: DataFrame, group: Sequence[str], order: str, name: str) -> DataFrame:
    """Adds the row's number in its group from 1 by ``order``, nulls first: its number in its bucket and the rows of the buckets before."""
    keys = ["_g", "_bucket"] if group else ["_bucket"]
    rows = bucketed(df, order)
    rows = rows.withColumn("_g", F.struct(*group)) if group else rows
    before = Window.partitionBy(*keys[:-1]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*keys).agg(F.count("*").alias("_c")).select(*keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_own", own).join(bases, keys).withColumn(name, F.col("_base") + F.col("_own")).drop("_g", "_bucket", "_own", "_base")
