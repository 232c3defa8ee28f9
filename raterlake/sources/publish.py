"""Publishing a release: staged, checked, then put in place as a whole.

A release is written below a staging folder beside its place and gets its checksums there. It is
published by renaming: the old release steps aside, the new one takes its place, and
only then is the old one deleted. Renames are metadata operations of the file system, so readers
see the old release or the new one. A run that dies leaves its staging folder or the old
release aside, and recover() puts that right.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlake.functions.labels import label_positions
from raterlake.operators import agreement
from raterlake.sources import atomic, hashing, readers

#: What a release folder holds, in the order in which it is written.
PARTS = ("annotations/consensus", "annotations/per_rater", "splits", "statistics/alpha", "statistics/agreement", "taxonomy", "codebook")
#: Where the checksums of all other files stand.
CHECKSUMS = "checksums"
_STAGED, _ASIDE = ".staged-", ".aside"


def _place(spark: SparkSession, folder: str):
    """Hadoop's file system of ``folder``, and a function from text to its paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def codebook(labels: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """(dim, line): a Markdown codebook of (dim, position, label), a section a dimension with each label and its index from 0."""
    names = names or {}
    named = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("dim")), F.col("dim")) if names else F.col("dim")
    row = F.concat(F.lit("| "), F.replace("label", F.lit("|"), F.lit("\\|")), F.lit(" | "), (F.col("position") - 1).cast("string"), F.lit(" |"))
    head = F.concat(F.lit("## "), F.col("dim"), F.when(named != F.col("dim"), F.concat(F.lit(" — "), named)).otherwise(""), F.lit("\n\n| Label | Index |\n|-|-|\n"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", row.alias("row")))), lambda r: r["row"]), "\n")
    return labels.groupBy("dim").agg(F.concat(F.first(head), rows, F.lit("\n")).alias("line"))  # a vocabulary a dimension, which is small


def recover(spark: SparkSession, folder: str) -> str:
    """Ends what a run that died began: ``restored`` if the old release stood aside with none in its place, else ``clean``. Staging folders and releases aside are deleted. Not to be run beside a build of the same release."""
    files, path = _place(spark, folder)
    place, parent = path(folder), path(folder).getParent()
    aside, out = path(folder + _ASIDE), "clean"
    if files.exists(aside):
        if files.exists(place):
            files.delete(aside, True)
        else:
            files.rename(aside, place)
            out = "restored"
    if files.exists(parent):
        for found in files.listStatus(parent):
            if found.getPath().getName().startswith(place.getName() + _STAGED):
                files.delete(found.getPath(), True)
    return out


def publish(spark: SparkSession, staged: str, folder: str) -> None:
    """Puts the ``staged`` folder in the place of ``folder``, on the same file system."""
    files, path = _place(spark, folder)
    place, aside = path(folder), path(folder + _ASIDE)
    if files.exists(place):
        if not files.rename(place, aside):
            raise OSError(f"{folder} can't be moved aside")
    if not files.rename(path(staged), place):
        if files.exists(aside):
            files.rename(aside, place)
        raise OSError(f"{staged} can't be moved to {folder}")
    files.delete(aside, True)


def listed(spark: SparkSession, folder: str, leave_out: Iterable[str] = (CHECKSUMS,)) -> DataFrame:
    """(path, length, sha256) of the data files of a release, paths being relative to it."""
    out = hashing.file_hashes(spark, folder)
    return out.where(~F.split_part("path", F.lit("/"), F.lit(1)).isin(list(leave_out)))


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """(status, n) of a release's files against its checksums, wherever it stands."""
    from raterlake.operators.release import verify_checksums

    return verify_checksums(readers.read_checksums(spark, f"{folder}/{CHECKSUMS}"), listed(spark, folder), "path")


def build_release(folder: str, consensus: DataFrame, per_rater: DataFrame, dims: Sequence[str], key: str = "patch_id", split: str = "split", rater: str = "engine", names: Mapping[str, str] | None = None, texts: Mapping[str, str] | None = None) -> DataFrame:
    """Builds a release and puts it in the place of ``folder`` as a whole; returns its checksums (path, sha256), with paths relative to it.

    Labels as CSV, the sorted ids of each split, agreement by dimension and by pairs of raters, the
    labels of the vocabularies, a codebook, and ``texts`` (name -> text, such as a licence). Everything is
    written by the executors to a staging folder, checksums last. If any of it
    fails, the release that was there stays as it was.
    """
    spark = consensus.sparkSession
    recover(spark, folder)
    staged = f"{folder}{_STAGED}{uuid.uuid4().hex}"
    try:
        readers.write_csv(consensus, f"{staged}/{PARTS[0]}")
        readers.write_csv(per_rater, f"{staged}/{PARTS[1]}")
        readers.write_id_lists(consensus, f"{staged}/{PARTS[2]}", key, split)
        readers.write_json_lines(agreement.alpha(per_rater, key, list(dims)), f"{staged}/{PARTS[3]}")
        if rater in per_rater.columns:
            readers.write_json_lines(agreement.agreement_matrix(per_rater, key, rater, list(dims)), f"{staged}/{PARTS[4]}")
        positions = label_positions(spark, dims)
        readers.write_json_lines(positions, f"{staged}/{PARTS[5]}")
        codebook(positions, names).repartition("dim").write.partitionBy("dim").text(f"{staged}/{PARTS[6]}")
        for name, text in (texts or {}).items():
            spark.createDataFrame([(text,)], "text string").coalesce(1).write.text(f"{staged}/{name}")
        readers.write_checksums(listed(spark, staged), f"{staged}/{CHECKSUMS}")
        publish(spark, staged, folder)
    except BaseException:
        files, path = _place(spark, folder)
        files.delete(path(staged), True)
        raise
    return readers.read_checksums(spark, f"{folder}/{CHECKSUMS}")


def freeze_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length, sha256_16) of frozen files, such as prompts and settings, wherever they stand."""
    return hashing.file_hashes(spark, folder, glob).select("path", "length", F.substring("sha256", 1, 16).alias("sha256_16"))


def run_record(spark: SparkSession, path: str, runs: DataFrame, inputs: Mapping[str, tuple[str, str]], settings: Mapping[str, object], limit: int = 10_000) -> dict:
    """Writes the manifest of a run as one JSON file that is replaced as a whole: ``settings``, the rows of ``runs`` (calls.run_manifest), and the sha256 of each input (name -> folder and file name; ``n/a`` if absent). Returns it."""
    rows = [r.asDict(recursive=True) for r in runs.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"a manifest has at most {limit} runs")
    sums = {}
    for name, (folder, file) in inputs.items():
        found = hashing.file_hashes(spark, folder, file).where(F.col("path") == file).first() if atomic.exists(spark, f"{folder}/{file}") else None
        sums[name] = found["sha256"] if found else "n/a"
    record = {**settings, "inputs_sha256": sums, "runs": rows}
    atomic.write_text(spark, path, json.dumps(record, ensure_ascii=False, indent=2, default=str))
    return record
