"""Readers of run folders, and writers of exports."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, recursive: bool = False, glob: str | None = None, skip_bad: bool = False, one_line: bool = False) -> DataFrame:
    """CSV with a header, quoted line feeds and doubled quotes; all columns are strings unless a schema is given; a missing value is an empty string.

    ``skip_bad`` leaves out what can't be read of a broken or vanished file and
    keeps what was read before. ``one_line`` says that no value holds a line feed, so that a
    large file may be split over many tasks.
    """
    reader = spark.read.option("header", True).option("multiLine", not one_line).option("escape", '"').option("recursiveFileLookup", recursive)
    reader = reader.option("ignoreCorruptFiles", skip_bad).option("ignoreMissingFiles", skip_bad)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    return df.na.fill("")


#: Different layouts (which wanted column stands where, and how many there are) that the files of a folder may have; each is read on its own.
MOST_HEADERS = 200
#: Columns that rows and reports of a quarantine have.
QUARANTINE = "file string, record string, reason string"


def headers(spark: SparkSession, folder: str, glob: str = "*.csv", recursive: bool = True) -> DataFrame:
    """(file, line): each file's first line, without a byte order mark."""
    lines = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).text(folder)
    first = lines.where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), "value").groupBy("file").agg(F.min_by("value", "n").alias("line"))
    return first.select("file", F.regexp_replace("line", "^\ufeff|\r$", "").alias("line"))


def _layouts(found: DataFrame, wanted: Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """(header lines, column names) of files that can be read together: as many columns, and the ``wanted`` ones at the same places."""
    lines = [r["line"] for r in found.select("line").distinct().limit(20 * MOST_HEADERS + 1).collect()]
    by: dict[tuple, tuple[list[str], list[str]]] = {}
    for line in sorted(lines):
        names = [n.strip() for n in next(csv.reader([line]), [])]
        key = (len(names), *(names.index(w) if w in names else -1 for w in wanted))
        by.setdefault(key, ([], names))[0].append(line)
    if len(by) > MOST_HEADERS or len(lines) > 20 * MOST_HEADERS:
        raise ValueError(f"the files have more than {MOST_HEADERS} different layouts")
    return list(by.values())


def _shard_parts(spark: SparkSession, folder: str, kinds: dict[str, str], required: Sequence[str], recursive: bool, skip_bad: bool, first_header: bool) -> tuple[list[DataFrame], DataFrame]:
    """Rows of each layout with _file, _line and _bad (a record that its layout doesn't fit), and (file, reason) of files that are left out."""
    glob = "shard_*.csv"
    found = headers(spark, folder, glob, recursive)
    parts, out = [], [spark.createDataFrame([], "file string, reason string")]
    layouts = _layouts(found, list(kinds))
    shown = set(kinds)
    if first_header and layouts:  # columns that the first file lacks are dropped, as one header is written for all
        top = found.agg(F.min_by("line", F.split("file", "/")).alias("line")).first()["line"]
        shown = {n.strip() for n in next(csv.reader([top or ""]), [])}
    for lines, names in layouts:
        own = found.where(F.col("line").isin(lines)).select(F.col("file").alias("_file")) if len(layouts) > 1 else None
        lacking = [c for c in required if c not in names]
        if lacking:
            out.append(found.where(F.col("line").isin(lines)).select("file", F.lit(f"no column {lacking[0]}").alias("reason")))
            continue
        unique = [n if n and names.index(n) == i else f"_c{i}" for i, n in enumerate(names)]
        schema = ", ".join(f"`{n}` string" for n in unique) + ", _bad string"
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", recursive).option("pathGlobFilter", glob)
        read = reader.option("ignoreCorruptFiles", skip_bad).option("ignoreMissingFiles", skip_bad).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(schema).csv(folder)
        cell = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
        columns = [(cell(c) if c in names and c in shown else F.lit("")).alias(c) for c in kinds]
        read = read.select(*columns, F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"), "_bad")
        parts.append(read if own is None else read.join(own, "_file", "left_semi"))
    return parts, reduce(DataFrame.unionByName, out)


def _kinds(schema: str, named: Sequence[str]) -> dict[str, str]:
    kinds = dict(part.split(None, 1) for part in (p.strip() for p in schema.split(",")))
    missing = [c for c in named if c not in kinds]
    if missing:
        raise ValueError(f"columns missing in the schema: {missing}")
    return kinds


def read_shards(spark: SparkSession, folder: str, schema: str, keys: Sequence[str] = ("patch_id", "engine"), required: Sequence[str] = ("D1",), keep_blank: bool = False, recursive: bool = True, dedup: bool = True, skip_bad: bool = False, first_header: bool = False) -> DataFrame:
    """All shard_*.csv of a folder, by their own headers: a file without a required column is left out, a column that it lacks is empty, and others are ignored.

    The first row a key is kept in the order of path parts and lines (all rows
    without ``dedup``); rows with a blank first key go unless ``keep_blank``. A file that can't be read to its end is an
    error; with ``skip_bad`` what was read before is kept (read_quarantined() says what is left out). With ``first_header`` columns
    that the first file lacks are empty, as where one file's header is written for all.
    """
    kinds = _kinds(schema, (*required, *keys))
    parts, _ = _shard_parts(spark, folder, kinds, required, recursive, skip_bad, first_header)
    if not parts:
        return spark.createDataFrame([], schema)
    df = reduce(DataFrame.unionByName, parts).select(*(F.col(c).cast(kind).alias(c) if kind != "string" else F.col(c) for c, kind in kinds.items()), "_file", "_line")
    if not keep_blank:
        df = df.where(f"trim({keys[0]}) <> ''")
    if not dedup:
        return df.drop("_file", "_line")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.split("_file", "/"), "_line"))
    return df.withColumn("_n", first).where("_n = 1").drop("_n", "_file", "_line")


def read_quarantined(spark: SparkSession, folder: str, schema: str, keys: Sequence[str] = ("patch_id", "engine"), required: Sequence[str] = ("D1",), recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, set aside): all sound rows of the shards, not deduplicated, and QUARANTINE rows for all that is left out.

    Set aside with a reason: records with more or fewer cells than their file's header, records with a blank key,
    values that their column's type can't hold, files without a required column, and
    files that hold more than a header but gave no record (unreadable). Every record is in one of the two.
    """
    kinds = _kinds(schema, (*required, *keys))
    parts, left_out = _shard_parts(spark, folder, kinds, required, recursive, True, False)
    files = left_out.select("file", F.lit(None).cast("string").alias("record"), "reason")
    if not parts:
        return spark.createDataFrame([], schema), files
    df = reduce(DataFrame.unionByName, parts)
    wrong = [F.when((F.col(c) != "") & F.col(c).try_cast(kind).isNull(), F.lit(f"{c} is no {kind}")) for c, kind in kinds.items() if kind != "string"]
    blank = [F.when(F.trim(c) == "", F.lit(f"{c} is blank")) for c in keys]
    marked = df.withColumn("_why", F.coalesce(F.when(F.col("_bad").isNotNull(), F.lit("cells don't fit the header")), *blank, *wrong, F.lit("")))
    rows = marked.where("_why = ''").select(*(F.col(c).try_cast(kind).alias(c) if kind != "string" else F.col(c) for c, kind in kinds.items()))
    aside = marked.where("_why <> ''").select(F.col("_file").alias("file"), F.coalesce("_bad", F.to_json(F.struct(*kinds))).alias("record"), F.col("_why").alias("reason"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "shard_*.csv").load(folder)
    head = headers(spark, folder, "shard_*.csv", recursive).select("file", (F.octet_length("line") + 8).alias("head"))
    silent = listed.select(F.col("_metadata.file_path").alias("file"), "length").join(head, "file", "left").where(F.col("head").isNull() | (F.col("length") > F.col("head")))
    unread = silent.join(marked.select(F.col("_file").alias("file")).distinct(), "file", "left_anti").join(left_out.select("file"), "file", "left_anti")
    return rows, aside.unionByName(files).unionByName(unread.select("file", F.lit(None).cast("string").alias("record"), F.lit("unreadable").alias("reason")))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON state as one row; None if the file is empty, as after a broken write."""
    text = spark.read.text(path, wholetext=True).first()
    return spark.read.option("multiLine", True).json(path) if text and text[0].strip() else None


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a list with one id a line; blank lines are none."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of a tab-separated list with a header, whichever column comes first."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    name = "path" if "path" in df.columns else "file"
    return df.select(F.col(name).alias("path"), F.lower("sha256").alias("sha256"))


def read_files(spark: SparkSession, folder: str, glob: str = "*", content: bool = False) -> DataFrame:
    """(path, split, name, length) of files below a folder, the split being the parent folder; with ``content`` their sha256 too."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    parts = F.split("path", "/")
    columns = [F.col("path"), F.element_at(parts, -2).alias("split"), F.element_at(parts, -1).alias("name"), F.col("length")]
    return df.select(*columns, F.sha2("content", 256).alias("sha256")) if content else df.select(*columns)


def coalesced_pool(sources: Sequence[DataFrame], key: str, limit: int) -> DataFrame:
    """Items of several sources, earlier sources first, one row an item, later sources only to reach ``limit``."""
    ranked = None
    for rank, df in enumerate(sources):
        own = df.withColumn("_source", F.lit(rank))
        ranked = own if ranked is None else ranked.unionByName(own, allowMissingColumns=True)
    first = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_source"))).where("_n = 1").drop("_n")
    return first.orderBy("_source", key).limit(limit).drop("_source")


def write_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None, strict: bool = False) -> None:
    """The given fields only (all without any given), missing ones empty, as text; with ``strict`` a column that isn't among the fields is an error."""
    known, fields = set(df.columns), fields or df.columns
    extra = sorted(known - set(fields))
    if strict and extra:
        raise ValueError(f"columns that are no fields: {extra}")
    df.select(*(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in known else F.lit("").alias(f) for f in fields)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


#: Rows of a bucket that one task writes.
FILE_ROWS = 1_000_000


def write_buckets(members: DataFrame, path: str, bucket: str = "bucket", rows: int = FILE_ROWS) -> DataFrame:
    """One folder a bucket, in files of about ``rows`` rows: a large bucket is dealt over as many tasks as its count asks for. Also a manifest of (bucket, n) beside it, at ``path``_manifest, which is returned; a bucket without rows has no folder."""
    spark, others = members.sparkSession, [c for c in members.columns if c != bucket]
    counts = members.groupBy(bucket).agg(F.count("*").alias("n")).collect()  # a row a bucket, which are labels and tiers
    sizes = spark.createDataFrame([(r[0], r["n"]) for r in counts], f"{bucket} {members.schema[bucket].dataType.simpleString()}, n long")
    parts = F.broadcast(sizes.select(F.struct(bucket).alias("_b"), F.ceil(F.col("n") / rows).alias("_parts")))
    dealt = members.withColumn("_b", F.struct(bucket)).join(parts, "_b").withColumn("_salt", F.pmod(F.xxhash64(*others) if others else F.rand(1), F.col("_parts")))
    dealt.repartition(bucket, "_salt").drop("_b", "_parts", "_salt").write.mode("overwrite").partitionBy(bucket).parquet(path)
    sizes.coalesce(1).write.mode("overwrite").json(f"{path}_manifest")
    return sizes


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_checksums(files: DataFrame, path: str) -> None:
    """Tab-separated sha256 and path, sorted by path."""
    files.select("sha256", "path").orderBy("path").write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_id_lists(df: DataFrame, path: str, key: str, split: str) -> None:
    """Sorted ids in one folder a split."""
    df.select(F.col(key).cast("string").alias("id"), split).repartitionByRange(split, "id").sortWithinPartitions(split, "id").write.mode("overwrite").partitionBy(split).text(path)


def write_report(df: DataFrame, path: str, limit: int = 10_000) -> int:
    """A small result as one pretty-printed JSON file on the driver's side, for reports; more than ``limit`` rows are an error. Returns the rows."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2, default=str)
    return len(rows)


def markdown(df: DataFrame, title: str, limit: int = 1_000) -> str:
    """A small result as a Markdown table; more than ``limit`` rows are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a table has at most {limit} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), "|" + "-|" * len(df.columns), *map(line, rows)]) + "\n"


def read_config(text: str) -> dict[str, str]:
    """The top-level ``name: "value"`` scalars of a YAML text, which is all that prompts and settings need; other lines are ignored."""
    found = {}
    for line in text.splitlines():
        name, colon, value = line.partition(":")
        value = value.strip()
        if colon and name and not name[0].isspace() and len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            found[name.strip()] = value[1:-1]
    return found
