"""Near-duplicate documents by b-bit MinHash.

Signatures: HASHES minima a document. Bands of ROWS whole minima give the
candidates; the low two bits of every minimum, packed into longs, give a
collision-corrected similarity by bit counts, which throws away candidates that
are far below the threshold; the rest is confirmed on whole shingle sets.

A band's bucket is never expanded into rows of pairs. Each member is first
compared with the bucket's hub, the member that has most company over all its
bands: of a text and its altered copies that is the text itself, or what is
nearest to it. That joins all but a few of a group at one comparison a document.
A bucket whose members are still in several components is gone through again:
the members outside its largest component are compared with all others by their
bits (a sketch of 48 bytes), in blocks of a bounded number of rows; those of
different components that may be similar enough form families. Only the members of
families take their texts along: within a family, again in blocks, all pairs of different components that may be similar enough are confirmed on whole
sets. Only spanning links leave a task. A bucket of one large component and few
strangers moves each of its members once; a bucket of n members of which no two
are linked has n * n comparisons of sketches, and moves each n / 512 times.

A pair of similarity exactly 0.8 shares no band with probability
(1 - 0.8^4)^24 = 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlake.llm import kernels as K
from raterlake.llm.components import Forest, connected_components
from raterlake.llm.store import attached, drop, keep_ids, settle, small_batches, with_groups

BANDS, ROWS = 24, 4
#: Minima whose low bits are kept; the first BANDS * ROWS of them make the bands.
HASHES = 192
_MULTIPLIERS = K.constants(5, HASHES)
_ROW_WEIGHTS = K.constants(6, ROWS)
#: Longs that hold two bits of each minimum.
LANES = HASHES // 32
#: Estimates have a standard deviation of 0.034 at 0.8; a candidate goes only if it is over four of them below.
SLACK = 0.14
_LONGS = [f"s{i}" for i in range(LANES)]

_SCHEMA = "id long, n_shingles long, h1 long, h2 long, bands array<long>, " + ", ".join(f"{c} long" for c in _LONGS)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each run of documents: first row, end row, hashes of the n-word shingles, offsets."""
    for lo, hi, data, offsets in K.text_runs(column):
        words, by_doc, _, _ = K.word_hashes(data, offsets)
        yield lo, hi, *K.shingles(words, by_doc, n)


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, values, offsets in shingle_sets(batch.column(1), n):
                docs = hi - lo
                size, h1, h2 = np.zeros(docs, np.int64), np.zeros(docs, np.uint64), np.zeros(docs, np.uint64)
                for d in np.flatnonzero(np.diff(offsets)):
                    own = np.unique(values[offsets[d] : offsets[d + 1]])
                    size[d], h1[d] = len(own), own.sum(dtype=np.uint64)
                    h2[d] = K.mix(own ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64)
                least = K.minima(values, offsets, _MULTIPLIERS)
                bands = np.zeros((docs, BANDS), np.uint64)
                for r in range(ROWS):
                    bands += K.mix(least[:, r : BANDS * ROWS : ROWS]) * _ROW_WEIGHTS[r]
                low = (K.mix(least) >> np.uint64(7)) & np.uint64(3)
                lanes = [np.bitwise_or.reduce(low[:, 32 * i : 32 * i + 32] << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1) for i in range(LANES)]
                flat = pa.array(bands.ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, docs).cast(pa.int64()), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(docs + 1, dtype=np.int32) * BANDS), flat)] + [pa.array(x.view(np.int64)) for x in lanes],
                    names=["id", "n_shingles", "h1", "h2", "bands", *_LONGS],
                )

    return run


def estimated(a: str, b: str) -> F.Column:
    """Similarity from the packed two-bit minima: of unequal minima one in four agrees by chance."""
    unequal = F.lit(0)
    for i in range(LANES):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return 1 - unequal / F.lit(HASHES * 0.75)


def _confirm(n: int, percent: int):
    """Streams documents sorted by (pair key, role, id); the first of a key is the document that the others are compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base = None, None
        for batch in batches:
            keys, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            salts, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
            a, b = [], []
            for lo, hi, values, offsets in shingle_sets(batch.column(4), n):
                for i in range(lo, hi):
                    own = np.unique(values[offsets[i - lo] : offsets[i - lo + 1]])
                    if role[i] == 0:
                        key, base = (keys[i], salts[i]), own
                    elif key == (keys[i], salts[i]):
                        both = len(np.intersect1d(base, own, assume_unique=True))
                        if both and 100 * both >= percent * (len(base) + len(own) - both):
                            a.append(keys[i])
                            b.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have 100 * shared >= percent * all.

    Documents that many pairs name as ``a`` are salted: the pairs of one ``a``
    are dealt over tasks of some BLOCK pairs each, and its text goes to each.
    """
    pairs = with_groups(pairs, ["a"], salts=F.ceil(F.count("*") / BLOCK)).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    texts = keep_ids(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "left_semi")
    members = pairs.join(texts.select(F.col("id").alias("b"), "text"), "b").select(F.col("a").alias("key"), "salt", F.col("b").alias("id"), F.lit(1).alias("role"), "text")
    keys = pairs.select(F.col("a").alias("id"), "salt").distinct()
    bases = keys.join(texts, "id").select(F.col("id").alias("key"), "salt", "id", F.lit(0).alias("role"), "text")
    together = members.unionByName(bases).repartition("key", "salt").sortWithinPartitions("key", "salt", "role", "id")
    return together.mapInArrow(_confirm(n, percent), "a long, b long")


#: Rows of a block with texts, and of one of sketches; two blocks are compared in one task. Bytes of texts in a block (a longer text is a block of its own, or nearly so).
BLOCK, SKETCHES, BLOCK_BYTES = 512, 512, 32 << 20


def across(rows: DataFrame, group: list[str], block: int, size: str | None = None) -> DataFrame:
    """Rows (id, component) of each group as pairs of blocks: i of the rows outside the group's largest component (side 0), j of all its rows (side 1).

    Each row comes once for every pair of blocks that it takes part in; ``major``
    marks rows of the largest component. Groups of one component give nothing. Blocks have
    ``block`` rows and, where ``size`` names a column of bytes, BLOCK_BYTES on average.
    """
    size_of = F.col(size) if size else F.lit(0)
    sizes = rows.groupBy(*group, "component").agg(F.count("*").alias("n"), F.sum(size_of).alias("bytes"))
    stats = sizes.groupBy(*group).agg(F.max(F.struct("n", "bytes", "component")).alias("largest"), F.sum("n").alias("_n"), F.sum("bytes").alias("_bytes")).where("largest.n < _n")
    blocks = lambda n, b: F.greatest(F.ceil(n / block), F.ceil(b / BLOCK_BYTES)).cast("int")
    few = blocks(F.col("_n") - F.col("largest.n"), F.col("_bytes") - F.col("largest.bytes"))
    placed = attached(rows, stats.select(*group, "_n", "largest", few.alias("_few"), blocks(F.col("_n"), F.col("_bytes")).alias("_all")), group)
    placed = placed.withColumn("major", F.col("component") == F.col("largest.component")).drop("largest", "_n")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.where("not major").withColumn("i", place("_few")).withColumn("j", every("_all")).withColumn("side", F.lit(0))
    right = placed.withColumn("j", place("_all")).withColumn("i", every("_few")).withColumn("side", F.lit(1))
    return left.unionByName(right).drop("_few", "_all")


def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """All rows as one batch. Texts get 64-bit offsets: with 32 bits a column of over 2 GB would come as several batches."""
    table = pa.Table.from_batches(held)
    wide = {pa.string(): pa.large_string(), pa.binary(): pa.large_binary()}
    table = table.cast(pa.schema([pa.field(f.name, wide.get(f.type, f.type)) for f in table.schema])).combine_chunks()
    (batch,) = table.to_batches() or [pa.RecordBatch.from_pylist([], table.schema)]
    return batch


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """One batch a group of rows that are equal in the first ``keys`` columns, from batches in the order of these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = last is not None and first != last
        last = tuple(c[-1] for c in columns)
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if k and held:
                yield whole(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield whole(held)


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which sketches (rows of LANES words) are estimated to be at least so similar."""
    unequal = np.zeros((len(a), len(b)), np.uint8)  # at most HASHES
    for lane in range(a.shape[1]):
        x = a[:, lane][:, None] ^ b[:, lane][None, :]
        unequal += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
    return unequal <= (1 - least) * HASHES * 0.75


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _candidates(batch: pa.RecordBatch, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of side 0, some at a time, rows of side 1, and which of them are of different components and may be similar enough; no pair twice."""
    ids, component, major, side = (_column(batch, c) for c in ("id", "component", "major", "side"))
    sketch = np.stack([_column(batch, c).view(np.uint64) for c in _LONGS], axis=1)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for at in range(0, len(left), 256):
        some = left[at : at + 256]
        fit = _similar(sketch[some], sketch[right], least) & (component[some][:, None] != component[right][None, :])
        fit &= major[right][None, :] | (ids[some][:, None] < ids[right][None, :])
        if fit.any():
            yield some, right, fit


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _may_link(least: float):
    """Groups by (band, bucket, i, j) -> spanning links of the rows of different components that may be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 4):
            ids, forest, out = _column(batch, "id"), Forest(), []
            for some, right, fit in _candidates(batch, least):
                # a row of side 0 and its partners are one tree; of a partner of many rows the first joins the others
                first = fit.argmax(axis=0)
                touched = np.flatnonzero(fit.any(axis=0))
                for x in np.flatnonzero(fit.any(axis=1)):
                    joined = np.unique(first[touched[fit[x, touched]]])
                    out += [(int(ids[some[x]]), int(ids[some[y]])) for y in joined if forest.join(int(ids[some[x]]), int(ids[some[y]]))]
                for y in touched:
                    a, b = int(ids[some[first[y]]]), int(ids[right[y]])
                    if forest.join(a, b):
                        out.append((a, b))
            yield _links(out)

    return run


def _confirm_blocks(n: int, percent: int, least: float):
    """Groups by (family, i, j) -> spanning links, confirmed on whole sets, between the components that the rows had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 3):
            ids, component = _column(batch, "id"), _column(batch, "component")
            sets: list[np.ndarray] = []
            for lo, hi, values, offsets in shingle_sets(batch.column(batch.schema.get_field_index("text")), n):
                sets += [np.unique(values[offsets[d] : offsets[d + 1]]) for d in range(hi - lo)]
            forest, out = Forest(), []
            for some, right, fit in _candidates(batch, least):
                for x, y in zip(*np.nonzero(fit), strict=True):
                    x, y = some[x], right[y]
                    a, b = sets[x], sets[y]
                    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or forest.find(int(component[x])) == forest.find(int(component[y])):
                        continue
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        forest.join(int(component[x]), int(component[y]))
                        out.append((int(ids[x]), int(ids[y])))
            yield _links(out)

    return run


def _linked(shared: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the distinct sets ``reps`` (id, sketch) that share buckets (id, band, bucket, company), links confirmed on ``texts``."""
    if shared.isEmpty():
        return shared.sparkSession.createDataFrame([], "node long, component long")
    bucket, least = ["band", "bucket"], percent / 100 - SLACK
    company = shared.groupBy("id").agg(F.sum("company").alias("total"))
    crowded = settle(shared.drop("company").join(company, "id").join(reps.select("id", *_LONGS), "id"))
    sketch = F.struct("id", *_LONGS)
    hub = with_groups(crowded, bucket, hub=F.max(F.struct("total", (-F.col("id")).alias("order"), sketch.alias("doc")))).select(sketch.alias("x"), F.col("hub.doc").alias("hub"))
    first = settle(hub.where("x.id <> hub.id").where(estimated("x", "hub") >= least).select(F.col("hub.id").alias("a"), F.col("x.id").alias("b")).distinct())
    links = settle(confirmed(first, texts, shingle, percent))
    parts = connected_components(links)
    drop(first)
    component = parts.select(F.col("node").alias("id"), "component")
    placed = settle(crowded.drop("total").join(component, "id", "left").withColumn("component", F.coalesce("component", "id")))
    drop(crowded)
    order = [*bucket, "i", "j"]
    blocks = across(placed, bucket, SKETCHES).select(*order, "side", "id", "component", "major", *_LONGS)
    near = settle(blocks.repartition(*order).sortWithinPartitions(*order).mapInArrow(_may_link(least), "a long, b long"))
    families = connected_components(near)
    docs_in = settle(placed.drop(*bucket).dropDuplicates(["id"]).join(families.select(F.col("node").alias("id"), F.col("component").alias("family")), "id"))
    drop(near, placed, families)
    if not docs_in.isEmpty():
        order = ["family", "i", "j"]
        found = keep_ids(texts, docs_in.select("id"), "left_semi")
        sized = settle(docs_in.join(found.select("id", F.octet_length("text").alias("bytes")), "id"))
        blocks = across(sized, ["family"], BLOCK, "bytes").join(found, "id").select(*order, "side", "id", "component", "major", *_LONGS, "text")
        drop(parts)
        more = settle(blocks.repartition(*order).sortWithinPartitions(*order).mapInArrow(_confirm_blocks(shingle, percent, least), "a long, b long"))
        parts = connected_components(links.unionByName(more))
        drop(more, sized)
    drop(links, docs_in)
    return parts


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the least id linked to it over any number of steps, itself included), kept.

    Words are runs of other than ASCII white space, A-Z lower-cased; documents
    link if 100 * shared >= percent * all of their distinct shingles. A text with
    fewer words than a shingle has one shingle, all its words; a null or empty
    text has none and links with nothing. Rows that repeat an id are not merged. A
    row without an id links with nothing: its component_id is null, and it is kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = settle(texts.mapInArrow(_signatures(shingle), _SCHEMA))
    sets = ["n_shingles", "h1", "h2"]
    named = signed.where("n_shingles > 0 and id is not null")
    groups = named.groupBy(*sets).agg(F.min("id").alias("rep"), F.count("*").alias("_n"))
    distinct = named.join(groups.select("rep"), F.col("id") == F.col("rep"), "left_semi")
    reps = settle(distinct.drop("n_shingles", "h1", "h2"))
    bucket = ["band", "bucket"]
    shared = settle(with_groups(reps.select("id", F.posexplode("bands").alias(*bucket)), bucket, having="_n > 1", company=F.count("*")))
    parts = _linked(shared, reps, texts, shingle, percent)
    drop(shared, reps)
    of_group = groups.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*sets, "_n", F.coalesce("component", "rep").alias("component_id"))
    linked = attached(named.select("id", *sets), settle(of_group), sets).select("id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))
