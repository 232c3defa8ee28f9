"""Tile grids over source images, splits, and manifest checks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlake.operators import ranks
from raterlake.operators.panel import independent_counts

# The five sources (id, width, height, split), tile size and stride.
SOURCES = [("yl_raw_001", 29400, 7511, "train"), ("yl_raw_002", 19220, 7511, "test"), ("yl_raw_003", 29127, 7511, "train"), ("yl_raw_004", 20950, 7511, "val"), ("yl_raw_005", 28223, 7511, "train")]
TILE, STRIDE = 512, 358


def sources(spark: SparkSession, rows: Sequence[tuple] = SOURCES) -> DataFrame:
    return spark.createDataFrame(rows, "source_id string, width int, height int, split string")


def tile_grid(images: DataFrame, tile: int = TILE, stride: int = STRIDE) -> DataFrame:
    """One row a tile (source_id, split, tx, ty, x, y, tile_id); the last of a row or column is moved in from the edge. An image smaller than a tile fails."""
    too_small = (F.col("width") < tile) | (F.col("height") < tile)
    checked = images.withColumn("width", F.when(too_small, F.raise_error(F.concat(F.lit("image smaller than a tile: "), "source_id"))).otherwise(F.col("width")))
    steps = lambda size: F.sequence(F.lit(0), F.ceil((F.col(size) - tile) / stride).cast("int"))
    grid = checked.withColumn("ty", F.explode(steps("height"))).withColumn("tx", F.explode(steps("width")))
    x, y = F.least(F.col("tx") * stride, F.col("width") - tile), F.least(F.col("ty") * stride, F.col("height") - tile)
    return grid.select("source_id", "split", "tx", "ty", x.alias("x"), y.alias("y")).withColumn("tile_id", F.concat_ws("_", "source_id", "x", "y"))


def group_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(kind, value, n): counts by each column and in all, from one pass."""
    return independent_counts(df, columns, total=True)


def split_leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """(group, n_splits): groups whose rows are in more than one split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def seeded(key: str, seed: int) -> Column:
    """A number from 0 to 2^52 by the md5 of seed and key: an order that looks random and stays."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 13), 16, 10).cast("long")


def hash_split(df: DataFrame, key: str, parts: Sequence[tuple[str, float]] = (("train", 0.8), ("val", 0.1), ("test", 0.1)), seed: int = 42) -> DataFrame:
    """Adds split: each row by the hash of its key, so a row keeps its split whatever else is in the table; shares hold on average."""
    u, out, edge = seeded(key, seed) / float(1 << 52), F.lit(parts[-1][0]), sum(share for _, share in parts[:-1])
    for name, share in reversed(parts[:-1]):
        out = F.when(u < edge, name).otherwise(out)
        edge -= share
    return df.withColumn("split", out)


def rank_split(df: DataFrame, key: str, parts: Sequence[tuple[str, float]] = (("train", 0.8), ("val", 0.1), ("test", 0.1)), seed: int = 42) -> DataFrame:
    """Adds split with exact sizes: rows in the order of a seeded hash, each part but the last getting the whole number below its share of the rows."""
    ordered = ranks.numbered(df.withColumn("_h", seeded(key, seed)), [], "_h", "_row")
    n, upto, edges, out = df.count(), 0, [], F.lit(parts[-1][0])
    for name, share in parts[:-1]:
        upto += math.floor(n * share)
        edges.append((name, upto))
    for name, edge in reversed(edges):
        out = F.when(F.col("_row") <= edge, name).otherwise(out)
    return ordered.withColumn("split", out).drop("_h", "_row")


def with_source(tiles: DataFrame, images: DataFrame, key: str = "source_id") -> DataFrame:
    """Each tile's split and source size; an unknown source has no split and size 0."""
    known = images.select(key, "split", "width", "height")
    return tiles.join(F.broadcast(known) if images.count() <= 100_000 else known, key, "left").withColumns({"split": F.coalesce("split", F.lit("")), "width": F.coalesce("width", F.lit(0)), "height": F.coalesce("height", F.lit(0))})


def reconcile(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(side, n): rows of one table without a partner in the other."""
    only = lambda a, b, name: a.join(b, key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    e, f = expected.select(key).distinct(), found.select(key).distinct()
    return only(e, f, "expected_only").unionByName(only(f, e, "found_only"))


def rebuild_verdict(manifest: DataFrame, disk: DataFrame, key: str, group: str, split: str) -> DataFrame:
    """(manifest_only, disk_only, leaking, duplicates, consistent): a manifest against the files found. Duplicate keys are reported and don't count against it."""
    counts = reconcile(manifest, disk, key).agg(*(F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0)).alias(name) for side, name in (("expected_only", "manifest_only"), ("found_only", "disk_only"))))
    leaks = split_leaks(manifest, group, split).agg(F.count("*").alias("leaking"))
    repeats = manifest.groupBy(key).count().where("count > 1").agg(F.count("*").alias("duplicates"))
    row = counts.join(F.broadcast(leaks)).join(F.broadcast(repeats))  # one row each
    return row.withColumn("consistent", (F.col("manifest_only") == 0) & (F.col("disk_only") == 0) & (F.col("leaking") == 0))


def overlap(tile: int = TILE, stride: int = STRIDE) -> tuple[int, float]:
    """How many pixels neighbouring tiles share, and which part of a tile that is."""
    return tile - stride, (tile - stride) / tile


def parse_tile_name(name: Column) -> Column:
    """struct(source_id, x, y) of source_x_y.png; null parts if the name is not of that form."""
    pattern = r"^(.+)_(\d+)_(\d+)\.png$"
    ok = name.rlike(pattern)
    return F.struct(*(F.when(ok, F.regexp_extract(name, pattern, i).cast(t)).alias(n) for i, n, t in ((1, "source_id", "string"), (2, "x", "int"), (3, "y", "int"))))
