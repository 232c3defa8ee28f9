"""Small files that are replaced as a whole, in any file system that Spark writes to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, files = _files(spark, path)
    return files.exists(hadoop)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if it is absent."""
    hadoop, files = _files(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(hadoop)) if files.exists(hadoop) else []


def delete(spark: SparkSession, path: str) -> None:
    hadoop, files = _files(spark, path)
    files.delete(hadoop, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts ``text`` in the place of the file: written and closed beside it, then renamed over it in one step, so a reader finds the old text or the new one, on a local disk and where the file system's own rename is atomic, as in HDFS."""
    jvm = spark._jvm
    place, files = _files(spark, path)
    local = files.getUri().getScheme() == "file"
    if local:
        files = files.getRawFileSystem() if hasattr(files, "getRawFileSystem") else files  # without a checksum file beside, which can't be replaced together with it
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = files.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.hsync()
    stream.close()
    gateway = spark.sparkContext._gateway
    if local:  # Hadoop's rename would first delete what is there
        options = gateway.new_array(jvm.java.nio.file.CopyOption, 1)
        options[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
        at = lambda p: jvm.java.nio.file.Paths.get(files.makeQualified(p).toUri())
        jvm.java.nio.file.Files.move(at(beside), at(place), options)
        return
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, place, how)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text; None if it is absent or blank. The file is opened once, so a replacement meanwhile doesn't mix with it."""
    hadoop, files = _files(spark, path)
    if not files.exists(hadoop):
        return None
    stream = files.open(hadoop)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return text if text.strip() else None
