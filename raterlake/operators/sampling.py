"""Stratified and seeded samples, and statistics of number arrays."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.operators import ranks
from raterlake.operators.tiling import seeded
from raterlake.session import ship


def with_quantiles(df: DataFrame, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``df`` and one column a wanted quantile: name -> (column, level), linearly interpolated over the whole table and exact."""
    for column in sorted({c for c, _ in wanted.values()}):
        names = {name: q for name, (c, q) in wanted.items() if c == column}
        found = ranks.quantiles(df, [], column, sorted(set(names.values())))
        row = found.agg(*(F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for name, q in names.items()))
        df = df.join(F.broadcast(row))  # one row
    return df


def pick_strata(df: DataFrame, key: str, strata: Sequence[tuple[str, Column]], n: int = 4) -> DataFrame:
    """Up to ``n`` rows a stratum by key (as text order if the key is text), a row going to the first stratum that picks it.

    A stratum needs no more than its first n rows and as many for each stratum before it;
    these few candidates are cut down in every partition before they meet, and
    one fold over them, strata in order, does the picking. One pass over ``df``.
    """
    most = n * len(strata)
    tagged = df.withColumn("_s", F.explode(F.array_compact(F.array(*(F.when(rule, F.lit(i)) for i, (_, rule) in enumerate(strata))))))
    ranked = tagged.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy(key))).where(F.col("_r") <= most)
    few = ranked.groupBy().agg(F.array_sort(F.collect_list(F.struct("_s", "_r", F.struct(*df.columns).alias("row")))).alias("few"))  # at most `most` a stratum

    def pick(done: Column, x: Column) -> Column:
        taken = F.exists(done, lambda d: (d["row"][key] == x["row"][key]) & (d["_s"] != x["_s"]))
        full = F.size(F.filter(done, lambda d: d["_s"] == x["_s"])) >= n
        return F.when(taken | full, done).otherwise(F.concat(done, F.array(x)))

    picked = few.select(F.explode(F.aggregate("few", F.filter("few", lambda x: F.lit(False)), pick)).alias("p"))
    names = F.array(*(F.lit(name) for name, _ in strata))
    return picked.select("p.row.*", F.element_at(names, F.col("p._s") + 1).alias("stratum"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by the order of a seeded hash of their key."""
    return df.orderBy(seeded(key, seed), key).limit(n)


def array_mean(values: str) -> Column:
    return F.expr(f"aggregate({values}, 0D, (a, x) -> a + x) / size({values})")


def array_variance(values: str) -> Column:
    """Population variance (two passes over the array)."""
    return F.expr(f"aggregate({values}, 0D, (a, x) -> a + pow(x - aggregate({values}, 0D, (b, y) -> b + y) / size({values}), 2)) / size({values})")


def array_stats(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, mean, std, edge_var): population statistics of an array and the variance of neighbours' differences."""
    doubles = df.select(key, F.expr(f"transform({values}, x -> cast(x as double))").alias("v")).where("size(v) > 1")
    with_steps = doubles.withColumn("d", F.expr("zip_with(slice(v, 2, size(v) - 1), slice(v, 1, size(v) - 1), (a, b) -> a - b)")).withColumn("m", array_mean("v")).withColumn("dm", array_mean("d"))
    variance = lambda v, m: F.expr(f"aggregate({v}, 0D, (a, x) -> a + (x - {m}) * (x - {m})) / size({v})")
    return with_steps.select(key, F.col("m").alias("mean"), F.sqrt(variance("v", "m")).alias("std"), variance("d", "dm").alias("edge_var"))


def _matrix_kernel(rows: int, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            sizes, n = pc.list_value_length(values).to_numpy(zero_copy_only=False), batch.num_rows
            flat, at = values.flatten(), values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            holes = np.add.reduceat(np.append(flat.is_null().to_numpy(zero_copy_only=False), False), np.minimum(np.cumsum(at) - at, len(flat))) if len(flat) else np.zeros(n)
            sound = np.flatnonzero((np.nan_to_num(sizes, nan=-1) == rows * columns) & (holes == 0))
            out = np.full((4, n), np.nan)
            if len(sound):
                start = (np.cumsum(at) - at)[sound]
                x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)[start[:, None] + np.arange(rows * columns)].reshape(-1, rows, columns)
                out[0, sound], out[1, sound] = x.mean(axis=(1, 2)), x.std(axis=(1, 2))
                across, down = np.diff(x, axis=2), np.diff(x, axis=1)
                out[2, sound] = across.var(axis=(1, 2)) if columns > 1 else 0.0
                out[3, sound] = down.var(axis=(1, 2)) if rows > 1 else 0.0
            known = np.zeros(n, bool)
            known[sound] = True
            columns_out = [pa.array(c, mask=~known) for c in (out[0], out[1], (out[2] + out[3]) / 2, out[2], out[3])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns_out], names=["key", "mean", "std", "edge_var", "var_across", "var_down"])

    return run


def matrix_stats(df: DataFrame, key: str, values: str, rows: int, columns: int) -> DataFrame:
    """(key, mean, std, edge_var, var_across, var_down) of matrices that come as arrays of ``rows`` x ``columns`` numbers, row by row.

    Variances are of the population; edge_var is the mean of the variances of the
    differences between neighbours in a row and in a column (0 along an axis of one). Whole Arrow
    batches at a time; only key and numbers travel. Null for an array that is null, of another size or with a
    null in it.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    held = df.select(F.col(key).alias("key"), F.col(values).cast("array<double>").alias("values"))
    return held.mapInArrow(_matrix_kernel(rows, columns), f"key {kind}, mean double, std double, edge_var double, var_across double, var_down double").withColumnRenamed("key", key)
