"""Collocations: phrases whose words stand together far more often than apart.

Counts go in two steps. Count-min sketches, made in every task and merged, overestimate how
often each n-gram stands, so what they put below the threshold is surely rare. Another pass
counts only the survivors, exactly and by their text. An n-gram is looked at only if
both of its parts of n-1 words survive, so each length has a sketch of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlake.llm import kernels as K
from raterlake.llm.store import drop, settle, small_batches

#: Words of a phrase at most.
LONGEST = 4
#: Rows of a sketch, and its cells a row: about one for BYTES_A_CELL bytes of text, from 2^MIN_BITS to 2^MAX_BITS. Beyond that a sketch rules out less, and the exact count has more to do.
DEPTH, BYTES_A_CELL, MIN_BITS, MAX_BITS = 2, 48, 16, 26
#: Cells of a chunk, as which sketches travel.
CHUNK = 1 << 16
#: Cells stop here; any threshold up to it can be asked of them.
FULL = 255
#: Counts that a task sums before it passes them on to Spark's own aggregate, which has room to spill.
HELD = 300_000
#: Salts of a language in the first step of the ranking.
SALTS = 16

_PARTS = np.zeros(256, bool)
_PARTS[list(b"\t\n\v\f\r .,;:!?")] = True
_SEEDS = K.constants(31, DEPTH)


def _normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lowered, runs of space and tab as one space, and the documents' new offsets."""
    data = K._LOWER[data]
    data[data == 9] = 32
    blank = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return data[keep], total[offsets]


class Run:
    """The words of a run of texts: starts, ends, which ones the next word follows in the same piece, and two hashes that tell languages apart."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.data, offsets = _normal(data, offsets)
        self.starts, self.ends, by_doc = K.spans(self.data, offsets, _PARTS)
        n = len(self.starts)
        self.lang = np.repeat(langs, np.diff(by_doc))
        self.joined = np.zeros(n, bool)
        if n > 1:
            self.joined[:-1] = (self.starts[1:] - self.ends[:-1] == 1) & (self.data[np.minimum(self.ends[:-1], len(self.data) - 1)] == 32)
            last = by_doc[1:] - 1  # a document's last word; of an empty one, the last before it
            self.joined[last[last >= 0]] = False
        self.totals = []
        for second in (False, True):
            words = K.span_hash(K.prefix(self.data, second), self.starts, self.ends, second)
            self.totals.append(K.prefix(K.mix(words ^ K.mix(self.lang.astype(np.uint64))), second))

    def hashes(self, at: np.ndarray, n: int, second: bool = False) -> np.ndarray:
        """Hash of the n words from each of ``at``."""
        return K.span_hash(self.totals[second], at, at + n, second)

    def grams(self, sketches: list[list[np.ndarray]], upto: int) -> Iterator[tuple[int, np.ndarray]]:
        """(n, first words) of the n-grams up to ``upto`` words that no sketch rules out, ``sketches`` having the bits of the first lengths."""
        alive = np.ones(len(self.starts), bool)
        for n in range(1, upto + 1):
            if n > 1:
                alive = alive[:-1] & alive[1:] & self.joined[: max(len(alive) - 1, 0)]
            if len(sketches) >= n and alive.any():
                at = np.flatnonzero(alive)
                h, keep = self.hashes(at, n), np.ones(len(at), bool)
                for bits, seed in zip(sketches[n - 1], _SEEDS, strict=True):
                    cell = _cells(h, seed, len(bits) * 8)
                    keep &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
                alive[at[~keep]] = False
            yield n, np.flatnonzero(alive)


def _cells(h: np.ndarray, seed: np.uint64, width: int) -> np.ndarray:
    return (K.mix(h ^ seed) >> np.uint64(65 - int(width).bit_length())).astype(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str] | None = None) -> Iterator[Run]:
    """Runs of the batches' texts. A language is a hash of its name; ``names`` gets the names by their hashes."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        words = langs.dictionary.to_pylist()
        codes = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little", signed=True) for w in words], np.int64)
        own = codes[langs.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        if names is not None:
            names.update(zip(codes.tolist(), words, strict=True))
        for lo, hi, data, offsets in K.text_runs(batch.column("text")):
            yield Run(data, offsets, own[lo:hi])


SKETCH = "chunk int, cells binary"


def _sketcher(held, n: int, width: int):
    """A task's sketch of the n-grams that the sketches so far leave, as compressed chunks."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = unpacked(held.value)
        rows = np.zeros((DEPTH, width), np.uint8)
        for run in _runs(batches):
            *_, (_, at) = run.grams(sketches, n)
            h = run.hashes(at, n)
            for row, seed in zip(rows, _SEEDS, strict=True):
                cells, counts = np.unique(_cells(h, seed, width), return_counts=True)
                row[cells] = np.minimum(row[cells] + np.minimum(counts, FULL), FULL)
        flat = rows.reshape(-1, min(CHUNK, width))
        full = np.flatnonzero(flat.any(axis=1))
        for part in np.array_split(full, max(1, len(full) // 256)):
            yield pa.record_batch({"chunk": pa.array(part, pa.int32()), "cells": pa.array([zlib.compress(flat[i].tobytes(), 1) for i in part], pa.binary())})

    return sketch


def _merger(least: int, size: int):
    """Chunks that come in order are summed one after the other; of each sum only a bit a cell is left, whether it reaches ``least``."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(size, np.uint16)
        for batch in batches:
            out = []
            for chunk, cells in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if chunk != now:
                    if now is not None:
                        out.append((now, np.packbits(total >= least, bitorder="little").tobytes()))
                    now, total = chunk, np.zeros(size, np.uint16)
                total = np.minimum(total + np.frombuffer(zlib.decompress(cells), np.uint8), FULL)
            if out:
                yield pa.record_batch({"chunk": pa.array([c for c, _ in out], pa.int32()), "cells": pa.array([b for _, b in out], pa.binary())})
        if now is not None:
            yield pa.record_batch({"chunk": pa.array([now], pa.int32()), "cells": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

    return merge


def unpacked(packed: list[bytes]) -> list[list[np.ndarray]]:
    """The rows of each length's sketch, as bits."""
    return [list(np.frombuffer(zlib.decompress(p), np.uint8).reshape(DEPTH, -1)) for p in packed]


GRAMS = "lang string, phrase string, k int, f long"


def _phrases(run: Run, at: np.ndarray, n: int) -> pa.Array:
    """The texts of the n-grams from ``at``."""
    lo, hi = run.starts[at], run.ends[at + n - 1]
    ends = np.concatenate([[0], np.cumsum(hi - lo)])
    flat = run.data[np.repeat(lo - ends[:-1], hi - lo) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])


def _counter(held, longest: int):
    """Exact counts of the n-grams that the sketches leave, summed over some megabytes of text at a time; k = 0 has the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, names = unpacked(held.value), {}
        pending, rows = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(pending).group_by(["lang", "phrase", "k"], use_threads=False).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "k", "f"])

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            codes, texts = pa.array(list(names), pa.int64()), pa.array(list(names.values()), pa.large_string())
            for b in table.to_batches(max_chunksize=20_000):
                yield pa.record_batch({"lang": texts.take(pc.index_in(b.column("lang"), codes)), "phrase": b.column("phrase"), "k": b.column("k"), "f": b.column("f")})

        def add(lang: np.ndarray, phrase: pa.Array, k: int, f: np.ndarray) -> int:
            pending.append(pa.table({"lang": lang, "phrase": phrase, "k": pa.array(np.full(len(f), k), pa.int32()), "f": pa.array(f, pa.int64())}))
            return len(f)

        for run in _runs(batches, names):
            langs, words = np.unique(run.lang, return_counts=True)
            rows += add(langs, pa.array([""] * len(langs), pa.large_string()), 0, words)
            for n, at in run.grams(sketches, longest):
                if not len(at):
                    continue
                a, b = run.hashes(at, n), run.hashes(at, n, True)
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                new = np.ones(len(at), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                first = np.flatnonzero(new)
                places = at[order[first]]
                rows += add(run.lang[places], _phrases(run, places, n), n, np.diff(np.append(first, len(at))))
            if rows > HELD:
                yield from out(summed())
                pending, rows = [], 0
                pa.default_memory_pool().release_unused()
        if pending:
            yield from out(summed())

    return count


def frequent_ngrams(docs: DataFrame, least: int, longest: int = LONGEST, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(n-grams, words): a settled table (lang, phrase, k words, f) of all n-grams of 1 to ``longest`` words that stand ``least`` times or more, and (lang, n) with each language's number of words. ``docs`` has lang (not null) and text."""
    if least > FULL:
        least_in_sketch = FULL  # cells stop there, so the sketch asks for less
    else:
        least_in_sketch = least
    spark = docs.sparkSession
    small_batches(spark)
    if bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MAX_BITS, max(MIN_BITS, (size // BYTES_A_CELL).bit_length()))
    width, packed = 1 << bits, []
    chunk = min(CHUNK, width)
    for n in range(1, longest + 1):
        held = spark.sparkContext.broadcast(packed)
        tasks = docs.select("lang", "text").mapInArrow(_sketcher(held, n, width), SKETCH)
        merged = settle(tasks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merger(least_in_sketch, chunk), SKETCH))
        level = np.zeros((DEPTH * width // chunk, chunk // 8), np.uint8)
        for row in merged.toLocalIterator():  # a bit a cell: 2 x 8 MB at most
            level[row["chunk"]] = np.frombuffer(row["cells"], np.uint8)
        packed = [*packed, zlib.compress(level.tobytes(), 1)]
        drop(merged)
        held.unpersist()
    held = spark.sparkContext.broadcast(packed)
    counted = docs.select("lang", "text").mapInArrow(_counter(held, longest), GRAMS).groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
    kept = settle(counted.where((F.col("k") == 0) | (F.col("f") >= least)))
    held.unpersist()
    return kept.where("k > 0"), kept.where("k = 0").select("lang", F.col("f").alias("n"))


def cohesion(a: Column, both: Column, scale: int = 2_000_000) -> Column:
    """floor(scale * a / both) without overflow: the product is a decimal of 38 digits."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)"), both.cast("decimal(20,0)")).cast("long")


def covers(longer: Column, a: Column, percent: int = 80) -> Column:
    """Whether ``longer`` is ``percent`` of ``a`` or more, in decimals."""
    wide = lambda c, k: c.cast("decimal(20,0)") * F.lit(k).cast("decimal(5,0)")
    return wide(longer, 100) >= wide(a, percent)


def _words(lo: str, n: str) -> str:
    return f"array_join(slice(w, {lo}, {n}), ' ')"


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, percent: int = 80, lang: str = "lang", text: str = "text", bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to four words.

    A-Z are lowered; pieces end at ``.,;:!?`` and at line feed to carriage return, words at
    space and tab. a is how often the phrase stands in pieces, l and r how often the two parts do
    of the cut with the least score (equal scores: after fewer words), n the language's words, score
    floor(2000000 a / (l + r)). A phrase within a longer one that stands ``percent`` of its times goes. Null
    languages are ``und``, null texts empty; columns beyond these two are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    grams, words = frequent_ngrams(rows, least, bits=bits)
    part = grams.select("lang", F.col("phrase").alias("part"), F.col("f").alias("n_part"))
    phrases = grams.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a")).withColumn("w", F.split("phrase", " "))
    cut = F.expr(f"explode(transform(sequence(1, k - 1), c -> struct(c, {_words('1', 'c')} first, {_words('c + 1', 'k - c')} rest)))")
    cuts = phrases.select("lang", "phrase", "a", cut.alias("x")).select("lang", "phrase", "a", "x.c", "x.first", "x.rest")
    first = cuts.join(part.withColumnsRenamed({"part": "first", "n_part": "l"}), ["lang", "first"])
    both = first.join(part.withColumnsRenamed({"part": "rest", "n_part": "r"}), ["lang", "rest"])
    scored = both.withColumn("score", cohesion(F.col("a"), F.col("l") + F.col("r")))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "c")).alias("b"))
    inner = F.expr(f"explode(flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> {_words('i', 'm')}))))")
    longer = phrases.where("k > 2").select("lang", inner.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~covers(F.col("longer"), F.col("a"), percent))
    flat = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = flat.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)  # SALTS x top rows a language
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
