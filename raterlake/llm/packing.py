"""Packing token sequences: best-fit decreasing over the whole corpus.

Pieces of one length are alike, so the packing is planned on the histogram of
lengths, of at most ``window`` numbers, and not on the pieces: for each length from
the longest, the tightest open window is found in a segment tree indexed by
remaining capacity, and as many pieces of that length go into windows of that
capacity as there are. The plan is the same as if the pieces were placed one by
one. The pieces then look up their place by their length and their rank among
the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlake.llm.store import settle, small_batches
from raterlake.llm.tokenizer import encoder

END = 1


class CapacityTree:
    """Segment tree over remaining capacities 0..size; a leaf counts the open windows of that capacity."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, n: int) -> None:
        node = self.width + capacity
        while node:
            self.count[node] += n
            node //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open window has."""
        node = self.width + least
        if self.count[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node *= 2
                    if not self.count[node]:
                        node += 1
                return node - self.width
            node //= 2
        return None


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing: (length, first rank, pieces, first sequence, offset), pieces of rank first.. going to one sequence each.

    The tightest window stays the tightest until no piece of the length fits it any
    more, so a run of equal windows is filled one after the other.
    """
    tree, open_windows, out, n_sequences = CapacityTree(window), {}, [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_windows.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first = window, n_sequences
                there = -(-left // (window // length))
                n_sequences += there
            else:
                first, there = open_windows[capacity].pop()
                tree.add(capacity, -there)
            each = capacity // length
            full = min(there, left // each)
            rest = left - full * each if full < there else 0
            for j in range(each):
                n = full + (j < rest)
                if n:
                    out.append((length, rank, n, first, window - capacity + j * length))
                    rank += n
            left -= full * each + rest
            put(capacity - each * length, first, full)
            if rest:
                put(capacity - rest * length, first + full, 1)
            used = full + (rest > 0)
            put(capacity, first + used, there - used)
    return out


def _pieces(path: str | None, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(END)
                packed = np.array(ids, "<u4")
                rows.extend((key, at, min(window, len(ids) - at), zlib.crc32(packed[at : at + window]), len(ids)) for at in range(0, len(ids), window))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _places(lengths: np.ndarray, ranks: np.ndarray, first: np.ndarray, offsets: np.ndarray):
    keys = (lengths.astype(np.int64) << 44) + ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")]
            sequence = first[at] + rank - ranks[at] if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offsets[at] if len(at) else sequence, pa.int64())], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and the end id 1. Documents over ``window`` tokens
    are first cut into full windows; what is left of them, and shorter documents,
    are packed by best-fit decreasing. A null or empty text is the end id alone. A
    string of the vocabulary's added tokens (<|endoftext|>) in a text is that one id,
    as the vocabulary's library has it by default.
    Rows with equal or null ids are documents of their own. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("id", "start"), F.lit(parts)).cast("int")
    pieces = settle(texts.mapInArrow(_pieces(tokenizer_path, window), "id long, start long, length long, ids_crc32 long, doc_tokens long").withColumn("bucket", bucket))
    counts = pieces.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    rows = plan(histogram, window)
    rows.sort()
    columns = [np.array([r[i] for r in rows], np.int64) for i in (0, 1, 3, 4)]
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32", "doc_tokens"))
    ranked = pieces.withColumn("own", own).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("own") - 1).select("id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    placed = ranked.mapInArrow(_places(*columns), "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
