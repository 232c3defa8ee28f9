"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are parted by size: class B holds the items of B/2 < n <= B shingles. For
each class a document is seen as windows of 2B shingles, B apart, so an item that
stands in it stands whole in one window, and their similarity is at least 0.19
however long the document is. A window is a candidate if one of its HASHES minima
equals the item's; an item with four fifths of its shingles in one window is missed
with probability 0.81^64 = 1e-6. An item that is scattered over a document shares
minima with several windows: of 600 items of 96 to 1,200 words in pieces of 25 words,
200 to 5,000 other words between them, all are found (a test repeats that). Candidates are confirmed by exact containment
of the item's shingles in the whole document. Items of one or two shingles are looked
up by the shingles themselves.

The items make an index that every task gets, and no row is shuffled. Items of more
than BLOCK_SHINGLES go through the corpus in blocks, one after the other, each
index being given up before the next is sent; so the memory is bounded and the scans
of the corpus grow with the benchmark, one for some 100,000 items.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlake.llm import kernels as K
from raterlake.llm.store import drop, settle, small_batches

HASHES = 64
_MULTIPLIERS = K.constants(31, HASHES)
#: Tells the hashes' minima apart in one index.
_SALTS = np.arange(HASHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Items of so many shingles or fewer are looked up by each shingle, as their share of a window is too small for minima.
FEW = 2
#: A block of items holds about so many shingles (40 MB), and 1 kB of minima for each item.
BLOCK_SHINGLES = 5_000_000


def _item_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.text_runs(batch.column(1)):
                words, by_doc, _, _ = K.word_hashes(data, offsets, loose=True)
                sets, long, words_in = [], [], np.diff(by_doc)
                for d in range(hi - lo):
                    own = words[by_doc[d] : by_doc[d + 1]]
                    used = min(n, len(own))
                    values = K.shingles(own, np.array([0, len(own)]), used, short=False)[0] if used else np.zeros(0, np.uint64)
                    sets.append(np.unique(values).view(np.int64))
                    long.append(len(values))
                keep = pa.array(words_in > 0)
                rows = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(np.minimum(words_in, n).astype(np.int32)), pa.array(long, pa.int32()), pa.array(sets, pa.list_(pa.int64()))],
                    names=["item", "width", "long", "shingles"],
                )
                yield rows.filter(keep)

    return run


class _Index:
    """A block of items: by shingle width, then by size class."""

    def __init__(self, rows: list, n: int):
        self.n = n
        self.items = [r["item"] for r in rows]
        self.sets = [np.array(r["shingles"], np.int64).view(np.uint64) for r in rows]
        self.short: dict[int, dict[int, list[int]]] = {}
        self.few: dict[int, list[int]] = {}
        classes: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            if r["width"] < n:
                self.short.setdefault(r["width"], {}).setdefault(int(self.sets[i][0]), []).append(i)
            elif len(self.sets[i]) <= FEW:
                for value in self.sets[i]:
                    self.few.setdefault(int(value), []).append(i)
            else:
                classes.setdefault(max(8, 1 << (r["long"] - 1).bit_length()), []).append(i)
        self.few_values = np.array(list(self.few), np.uint64)
        self.classes = []
        for block in sorted(classes):
            own = classes[block]
            least = np.stack([K.minima(self.sets[i], np.array([0, len(self.sets[i])]), _MULTIPLIERS)[0] for i in own])
            keys = K.mix(least + _SALTS[None, :]).ravel()
            order = np.argsort(keys)
            bits = min(24, max(16, int(len(keys) * 16).bit_length()))
            seen = np.zeros(1 << bits, bool)
            seen[keys >> np.uint64(64 - bits)] = True
            self.classes.append((block, keys[order], np.repeat(np.array(own), HASHES)[order], seen, np.uint64(64 - bits)))


def _candidates(index: _Index, values: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
    """(document, item) whose windows share a minimum."""
    found: set[tuple[int, int]] = set()
    sizes = np.diff(offsets)
    if not len(values) or not index.classes:
        return found
    base = index.classes[0][0]

    def blocks(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of blocks in ``values``, each block's document, and each document's first block."""
        per = (sizes + width - 1) // width
        first = np.concatenate([[0], np.cumsum(per)])
        doc = np.repeat(np.arange(len(sizes)), per)
        return offsets[doc] + (np.arange(first[-1]) - first[doc]) * width, doc, first

    starts, doc, first = blocks(base)
    levels = []
    for block, *rest in index.classes:
        s, d, f = blocks(block)
        pair = np.append(d[1:] == d[:-1], False)
        levels.append((np.searchsorted(starts, s), d, pair, rest))
    for k in range(HASHES):
        fine = np.minimum.reduceat(values * _MULTIPLIERS[k], starts)
        salt = _SALTS[k]
        for at, d, pair, (keys, items, seen, shift) in levels:
            least = np.minimum.reduceat(fine, at)
            joined = least.copy()
            joined[:-1] = np.where(pair[:-1], np.minimum(least[:-1], least[1:]), least[:-1])
            hashed = K.mix(joined + salt)
            hit = np.flatnonzero(seen[hashed >> shift])
            if len(hit):
                lo, hi = np.searchsorted(keys, hashed[hit], "left"), np.searchsorted(keys, hashed[hit], "right")
                for h, a, b in zip(hit[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                    found.update((int(d[h]), int(items[x])) for x in range(a, b))
    return found


def _search(shared, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: _Index = shared.value
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in K.text_runs(batch.column(1)):
                words, by_doc, _, _ = K.word_hashes(data, offsets, loose=True)
                out = []
                values, at = K.shingles(words, by_doc, index.n, short=False)
                by_document: dict[int, list[int]] = {}
                found = _candidates(index, values, at)
                if index.few:
                    hit = np.flatnonzero(np.isin(values, index.few_values))
                    found.update((int(d), i) for d, h in zip(np.searchsorted(at, hit, "right") - 1, hit, strict=True) for i in index.few[int(values[h])])
                for d, i in found:
                    by_document.setdefault(d, []).append(i)
                for d, items in by_document.items():
                    own = np.unique(values[at[d] : at[d + 1]])
                    for i in items:
                        both = len(np.intersect1d(own, index.sets[i], assume_unique=True))
                        if 100 * both >= percent * len(index.sets[i]):
                            out.append((d, i, both))
                for width, known in index.short.items():
                    values, at = K.shingles(words, by_doc, width, short=False)
                    hit = np.flatnonzero(np.isin(values, np.array(list(known), np.uint64)))
                    pairs = {(int(d), i) for d, h in zip(np.searchsorted(at, hit, "right") - 1, hit, strict=True) for i in known[int(values[h])]}
                    out.extend((d, i, 1) for d, i in pairs)
                out.sort()
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([lo + d for d, _, _ in out], pa.int64())), pa.array([index.items[i] for _, i, _ in out], pa.int64()), pa.array([len(index.sets[i]) for _, i, _ in out], pa.int64()), pa.array([b for _, _, b in out], pa.int64())],
                    names=["id", "item_id", "n_item_shingles", "n_shared"],
                )

    return run


def leaked_items(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, n_item_shingles, n_shared, containment): items of which ``percent`` or more of the distinct shingles stand in a document.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased, so
    punctuation, white space and case don't matter. An item with fewer words than
    a shingle counts as one shingle of all its words. Items without words, nulls
    and empty texts match nothing; repeated rows give a pair once; rows without an
    id give pairs without an id; items that share an id are told apart by their
    shingles, and each gives its pairs. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = settle(items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).distinct().mapInArrow(_item_sets(shingle), "item long, width int, long int, shingles array<long>"))
    total = known.agg(F.sum(F.size("shingles") + 8)).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_SHINGLES))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    found = []
    for block in range(n_blocks):
        rows = known.where(F.pmod(F.xxhash64("item", "shingles"), F.lit(n_blocks)) == block).collect()  # some BLOCK_SHINGLES
        index = spark.sparkContext.broadcast(_Index(rows, shingle))
        pairs = texts.mapInArrow(_search(index, percent), "id long, item_id long, n_item_shingles long, n_shared long")
        if n_blocks > 1:
            pairs = settle(pairs)
            index.destroy()
        found.append(pairs)
    drop(known)
    out = reduce(DataFrame.unionByName, found).distinct()
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles")).withColumnRenamed("id", id_col)
