"""SHA-256 of files below a folder, whatever their size."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fnmatch import fnmatch
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlake.session import ship

#: Files up to so many bytes are hashed by Spark's own function; longer ones in chunks of CHUNK bytes.
WHOLE, CHUNK = 32 << 20, 4 << 20


def stream_hash(uri: str) -> str:
    """SHA-256 of a file, read in chunks through the file system that its address names."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(quote(re.sub(r"^(\w+):/(?!/)", r"\1:///", uri), safe=":/"))
    out = hashlib.sha256()
    with system.open_input_stream(path) as stream:
        while chunk := stream.read(CHUNK):
            out.update(chunk)
    return out.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, uri in enumerate(batch.column("path").to_pylist()):  # a file at a time, so a task that is lost repeats few
            yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([stream_hash(uri)])], names=["path", "length", "sha256"])


def file_hashes(spark: SparkSession, folder: str, glob: str = "*", whole: int = WHOLE) -> DataFrame:
    """(path, length, sha256) of the files below ``folder``, paths being relative to it; hidden files and those with a leading underscore are left out, as Spark reads none of them. Empty files, which Spark doesn't read either, are listed by their addresses.

    Small files are hashed where Spark reads them, whatever store that is. Files of over
    ``whole`` bytes are listed only and dealt out one by one; a worker reads them in chunks through
    Arrow's file systems, so memory is constant and no file has to fit a row.
    """
    ship(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", "length").repartition("path").mapInArrow(_hashed, "path string, length long, sha256 string")
    files, none, found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), hashlib.sha256(b"").hexdigest(), []
    while files.hasNext():
        f = files.next()
        at = f.getPath().toString()
        if f.getLen() == 0 and not re.search(r"/[._]", at[len(root) :]) and fnmatch(f.getPath().getName(), glob):
            found.append((at, 0, none))
    empty = spark.createDataFrame(found, "path string, length long, sha256 string")
    return small.unionByName(large).unionByName(empty).withColumn("path", F.substring("path", F.lit(len(root) + 2), F.char_length("path")))
