"""Repeated passages: depth-limited most-significant-digit ordering of suffixes.

Two documents share a passage of ``length`` tokens if two suffixes agree through
that depth. Suffixes are ordered by wide digits, most significant first, and
after each pass those alone in their group are dropped, so only suffixes that
still may repeat go deeper:

0. Texts equal as a whole are all repeated but for the least document's, and go no
   further; only the least document's suffixes are ordered.
1. anchor digit. A suffix's window of ``length`` tokens is placed by its anchor,
   the leftmost least among the hashes of its ``digit``-token strings, which
   equal windows have at the same place. The windows of one document with one
   anchor follow each other; they travel as one row (a run), which is what keeps
   the shuffle near the size of the text and not at many times of it.
2. run digit. Inside a group, runs equal over all their tokens agree to full depth:
   all but the least document's are repeated passages. A run alone in its anchor's group is dropped.
3. side digits. Every window reaches half of the remaining depth to the left or to
   the right of its anchor, so of the runs left only those stay that share the
   tokens of one side with another document.
4. window digit. Of the runs left, every window is ordered through its whole depth.

Groups that are equal after the last pass are exactly the repeated windows.
Digits are compared as hashes: an anchor by 64 bits, a run by 112 more, a window by
96, made of two polynomials with different bases and values, so that a false
repeat is not to be expected (10^13 windows that get so far make 5 * 10^25 pairs,
and 2^96 is 8 * 10^28); whole texts are compared by sha-256.

Before rows are shuffled, runs and windows that another document of the same
megabyte of text has are settled there: but for the least document's they are
repeats, and go to any task. Groups are streamed in order, with one row carried from batch to batch, so a passage that a third of the documents
share needs no more memory than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlake.llm import kernels as K
from raterlake.llm.store import drop, keep_ids, settle, small_batches

#: Tokens of an anchor.
DIGIT = 16
#: Equal runs are merged up to about so many tokens, as 16 bits hold a length.
LONGEST = 1 << 14
#: Stands for all of a text.
WHOLE = -1
#: A text's copies are dealt over so many tasks.
SALTS = 16
#: Anchors are counted in one of so many documents; those of more than one in so many of the runs there, and so many runs at least, are hot.
SAMPLE, HOT_SHARE, HOT_RUNS = 64, 2_000, 64
#: Bit of the marks that says that a run's anchor is hot.
_HOT = 48


def _tokens(data: np.ndarray, offsets: np.ndarray, unit: str):
    """Token values, their offsets by document, and the tokens' byte starts and ends (None for bytes)."""
    if unit == "bytes":
        return data, offsets, None, None
    return K.word_hashes(data, offsets, lower=False)


def _settled(keys: tuple[np.ndarray, ...], ids: np.ndarray) -> np.ndarray:
    """Which rows have keys that a smaller id among these rows has too."""
    order = np.lexsort((ids, *keys[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    out = np.zeros(len(order), bool)
    sorted_ids = ids[order]
    out[order] = sorted_ids > sorted_ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _anywhere(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A first digit that deals rows out evenly."""
    return K.mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)).view(np.int64)


def _run_rows(length: int, unit: str, hot=None):
    """Texts -> runs; a run that is settled as a repeat has ~at for at. Runs of a ``hot`` anchor (a broadcast array) are dealt by anchor and run, and marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in K.text_runs(batch.column(1)):
                tokens, by_doc, _, _ = _tokens(data, offsets, unit)
                room = np.diff(by_doc) >= length
                if not room.any():
                    continue
                n = len(tokens) - DIGIT + 1
                total, total_2 = K.prefix(tokens), K.prefix(tokens, second=True)
                at = np.arange(n)
                hashed = K.span_hash(total, at, at + DIGIT)
                ok = np.zeros(len(tokens) + 1, np.int8)
                np.add.at(ok, by_doc[:-1][room], 1)
                np.add.at(ok, by_doc[1:][room] - length + 1, -1)
                first, last, anchor = K.anchors(hashed, np.cumsum(ok[:n], dtype=np.int8) > 0, length - DIGIT + 1)
                if not len(first):
                    continue
                doc = np.searchsorted(by_doc, first, "right") - 1
                begin = first - by_doc[doc]
                size = last - first + length
                half = (length - DIGIT) // 2
                # a side stops where the run does: no window reaches further there
                left = K.span_hash(total, np.maximum(anchor - half, first), anchor + DIGIT) >> np.uint64(48)
                right = K.span_hash(total, anchor, np.minimum(anchor + DIGIT + half, first + size)) >> np.uint64(48)
                check = K.span_hash(total_2, first, first + size, second=True) >> np.uint64(48)
                digit, span = hashed[anchor].view(np.int64), K.span_hash(total, first, first + size).view(np.int64)
                marks = ((check << np.uint64(32)) | (left << np.uint64(16)) | right).view(np.int64)  # 16 bits of each
                row, size = _merged(doc, digit, span, marks, begin, size)
                digit, span, marks, own, where = digit[row], span[row], marks[row], ids[lo:hi][doc[row]].astype(np.int64), (begin[row] << 16) | size
                done = _settled((digit, span, marks), own)
                if hot is not None:
                    often = np.isin(digit, hot.value)
                    digit[often] ^= K.mix(span[often].view(np.uint64)).view(np.int64)
                    marks[often] |= 1 << _HOT
                digit[done], span[done], marks[done], where[done] = _anywhere(own[done], where[done]), 0, 0, ~where[done]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digit, span, marks, own, where)], names=["anchor", "span", "marks", "id", "at"])

    return run


def _merged(doc: np.ndarray, anchor: np.ndarray, span: np.ndarray, marks: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal runs of a document that overlap, as in a text that repeats a word, become one: the first one's row number and the tokens they cover together."""
    order = np.lexsort((begin, marks, span, anchor, doc))
    d, a, s, c, b, n = (x[order] for x in (doc, anchor, span, marks, begin, size))
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (c[1:] != c[:-1]) | (b[1:] > b[:-1] + n[:-1]) | (b[1:] // LONGEST != b[:-1] // LONGEST)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    return order[first], b[last] + n[last] - b[first]


def _shared(group: np.ndarray, i: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether another document of the group has the same tokens on the left or on the right of the anchor."""
    out = np.zeros(len(group), bool)
    for side in ((marks >> 16) & 0xFFFF, marks & 0xFFFF):
        _, kind = np.unique((group << 16) | side, return_inverse=True)
        least, most = np.full(kind.max(initial=-1) + 1, 2**62), np.full(kind.max(initial=-1) + 1, -(2**62))
        np.minimum.at(least, kind, i)
        np.maximum.at(most, kind, i)
        out |= least[kind] < most[kind]
    return out


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, span, marks, id) -> rows that repeat a smaller document's run (open = false) and rows to order further (open = true).

    A group is ordered further if it has several kinds of run and several
    documents. Runs of a hot anchor stand alone here; what others have them on either side is asked
    later, by ``left`` and ``right``, which only they have. Carried from batch to batch: of such a group its last row's anchor,
    span and owner; of another the rows that may still be ordered further, which
    are rows of one document.
    """
    carry = None  # (anchor, span, marks, owner)
    held, held_mixed = tuple(np.zeros(0, np.int64) for _ in range(5)), False
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
        done = columns[4] < 0
        if done.any():
            none = pa.nulls(int(done.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(columns[3][done]), pa.array(~columns[4][done]), pa.array(np.zeros(done.sum(), bool)), none, none], names=["id", "at", "open", "left", "right"])
            columns = [c[~done] for c in columns]
        if not len(columns[0]):
            continue
        waiting = len(held[0]) > 0
        a, s, marks, i, at = (np.concatenate([h, c]) for h, c in zip(held, columns, strict=True))
        new_a = np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        new_s = np.ones(len(a), bool)
        new_s[1:] = new_a[1:] | (s[1:] != s[:-1]) | (marks[1:] != marks[:-1])
        if carry is not None:
            new_a[0] = a[0] != carry[0]
            new_s[0] = new_a[0] or s[0] != carry[1] or marks[0] != carry[2]
        owner = np.concatenate([[carry[3] if carry is not None else 0], i[new_s]])[np.cumsum(new_s)]
        group = np.cumsum(new_a)
        last = group[-1]
        kinds, mixed = np.zeros(last + 1, bool), np.zeros(last + 1, bool)
        kinds[group[new_s & ~new_a]] = True
        leader = np.concatenate([[0], i[new_a]])[group]
        mixed[group[i != leader]] = True
        if waiting:
            mixed[group[0]] |= held_mixed
        several = kinds & mixed
        several[0] |= carry is not None
        hot = np.zeros(last + 1, bool)
        hot[group[(marks >> _HOT) & 1 == 1]] = True
        several |= hot
        repeated = i > owner
        opened = ~repeated & several[group]
        inner = np.flatnonzero(opened & (group > group[0]) & (group < last) & ~hot[group])  # whole groups: a side must be shared
        opened[inner] = _shared(group[inner], i[inner], marks[inner])
        out = repeated | opened
        if several[last]:
            carry, held = (a[-1], s[-1], marks[-1], owner[-1]), tuple(x[:0] for x in held)
        else:
            keep = (group == last) & ~repeated
            carry, held, held_mixed = None, (a[keep], s[keep], marks[keep], i[keep], at[keep]), bool(mixed[last])
        cold = ~(opened & hot[group])[out]
        anchor = a[out] ^ K.mix(s[out].view(np.uint64)).view(np.int64)
        sides = [pa.array(K.mix((anchor ^ (side << 20 | k)).view(np.uint64)).view(np.int64), mask=cold) for k, side in ((1, (marks[out] >> 16) & 0xFFFF), (2, marks[out] & 0xFFFF))]
        yield pa.RecordBatch.from_arrays([pa.array(i[out]), pa.array(at[out]), pa.array(opened[out]), *sides], names=["id", "at", "open", "left", "right"])


def _window_rows(length: int, unit: str):
    """Texts and their open runs -> windows; one that is settled as a repeat has ~start for start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for lo, hi, data, offsets in K.text_runs(batch.column(1)):
                tokens, by_doc, _, _ = _tokens(data, offsets, unit)
                part = runs.slice(lo, hi - lo)
                packed = part.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy(zero_copy_only=False))
                begin, count = (packed >> 16), (packed & 0xFFFF) - length + 1
                ends = np.cumsum(count)
                within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
                where = np.repeat(begin, count) + within
                doc = np.repeat(doc, count)
                absolute = by_doc[doc] + where
                good = absolute + length <= by_doc[doc + 1]
                where, doc, absolute = where[good], doc[good], absolute[good]
                window = K.span_hash(K.prefix(tokens), absolute, absolute + length).view(np.int64)
                check = (K.span_hash(K.prefix(tokens, second=True), absolute, absolute + length, second=True) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                own, where = ids[lo:hi][doc].astype(np.int64), where.astype(np.int64)
                done = _settled((window, check), own)
                window[done], check[done], where[done] = _anywhere(own[done], where[done]), 0, ~where[done]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (window, check, own, where)], names=["window", "check", "id", "start"])

    return run


def _later_windows(length: int):
    """Rows sorted by (window, check, id) -> those whose document isn't the group's least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # (window, check, owner)
        for batch in batches:
            w, c, i, start = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            done = start < 0
            own, places = [i[done]], [~start[done]]
            if not done.all():
                w, c, i, start = (x[~done] for x in (w, c, i, start))
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
                new[0] = carry is None or (w[0], c[0]) != carry[:2]
                owner = np.concatenate([[carry[2] if carry else 0], i[new]])[np.cumsum(new)]
                carry = (w[-1], c[-1], owner[-1])
                own.append(i[i > owner])
                places.append(start[i > owner])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array((np.concatenate(places) << 16) | length)], names=["id", "at"])

    return run


_RUNS = "anchor long, span long, marks long, id long, at long"


def hot_anchors(docs: DataFrame, length: int, unit: str) -> np.ndarray:
    """Anchors that very many runs share, judged by a sample of the documents. They only decide how rows are dealt: fewer than HOT_SHARE numbers come to the driver."""
    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(_run_rows(length, unit), _RUNS).where("at >= 0")
    counts = settle(some.groupBy("anchor").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") >= max(HOT_RUNS, total / HOT_SHARE)).select("anchor").collect()
    drop(counts)
    return np.array([r["anchor"] for r in found], np.int64)


def repeated_runs(docs: DataFrame, length: int, unit: str) -> DataFrame:
    """(id, at): stretches of ``docs`` (id, text) that a smaller id also has, as ``start << 16 | tokens``, or WHOLE; they may overlap."""
    known = docs.where("id is not null and text is not null")
    digests = settle(known.select("id", F.unhex(F.sha2("text", 256)).alias("digest")))
    groups = digests.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    one_text = digests.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a = b").select("id")
    salted = digests.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    copies = settle(salted.join(groups, ["digest", "salt"]).where("id > least").select("id").distinct().join(one_text, "id", "left_semi"))
    drop(digests)
    whole = copies.select("id", F.lit(WHOLE).cast("long").alias("at"))
    known = keep_ids(known, copies, "left_anti")
    often = hot_anchors(known, length, unit)
    hot = docs.sparkSession.sparkContext.broadcast(often) if len(often) else None
    ordered = known.mapInArrow(_run_rows(length, unit, hot), _RUNS).repartition("anchor").sortWithinPartitions("anchor", "span", "marks", "id")
    found = settle(ordered.mapInArrow(_owners, "id long, at long, open boolean, left long, right long"))
    opened = found.where("open and left is null").select("id", "at")
    if hot is not None:  # of hot anchors those runs go on that share a side with another document
        runs = found.where("open and left is not null")
        for side in ("left", "right"):
            shared = settle(runs.groupBy(side).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(side))
            opened = opened.unionByName(keep_ids(runs, shared, "left_semi", side).select("id", "at"))
        opened = opened.distinct()
    deeper = known.join(opened.groupBy("id").agg(F.collect_list("at").alias("runs")), "id").select("id", "text", "runs")
    windows = deeper.mapInArrow(_window_rows(length, unit), "window long, check int, id long, start long")
    last = windows.repartition("window").sortWithinPartitions("window", "check", "id").mapInArrow(_later_windows(length), "id long, at long")
    return found.where("not open").select("id", "at").unionByName(settle(last)).unionByName(whole)


def _cut(length: int, unit: str, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(1)
            texts = batch.column(0)
            size, removed, n_spans, kept, spans = [], [], [], [], []
            for lo, hi, data, offsets in K.text_runs(texts):
                _, by_doc, starts, ends = _tokens(data, offsets, unit)
                for d in range(lo, hi):
                    own = data[offsets[d - lo] : offsets[d - lo + 1]]
                    size.append(len(own))
                    packed = np.array(runs[d].as_py() or [], np.int64)
                    tokens = int(by_doc[d - lo + 1] - by_doc[d - lo])
                    all_of_it = len(packed) > 0 and packed.min() == WHOLE and tokens >= length
                    packed = packed[packed != WHOLE]
                    change = np.zeros(tokens + 1, np.int64)
                    begin = np.minimum(packed >> 16, tokens)
                    np.add.at(change, begin, 1)
                    np.add.at(change, np.minimum(begin + (packed & 0xFFFF), tokens), -1)
                    change[0] += all_of_it
                    gone = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
                    edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
                    if unit != "bytes" and len(edges):
                        base = int(by_doc[d - lo])
                        edges = np.column_stack([starts[base + edges[:, 0]], ends[base + edges[:, 1] - 1]]) - int(offsets[d - lo])
                    left = np.ones(len(own), bool)
                    for b, e in edges:
                        left[b:e] = False
                    n_spans.append(len(edges))
                    removed.append(int(len(own) - left.sum()))
                    kept.append(own[left].tobytes())
                    spans.append(edges.ravel().tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.int64())), *(batch.column(2 + c) for c in range(extra))],
                names=["n_bytes", "n_removed", "n_spans", "kept_bytes", "spans", *(f"c{c}" for c in range(extra))],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = 50, unit: str = "words", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus n_bytes, n_removed, n_spans, kept_bytes (binary) and spans (byte starts and ends in turn).

    A stretch of ``length`` tokens (``bytes``, or ``words`` parted by ASCII white
    space) is removed from a document if a document with a smaller id has it too,
    judged on the input texts. A null text is empty; a row without an id is left
    as it is and removes nothing elsewhere. Rows that repeat an id don't remove each
    other and are cut alike; they should hold the same text. Columns of any name may stand beside:
    the five new ones replace columns of these names.
    """
    if not DIGIT < length < LONGEST:
        raise ValueError(f"length is {length}; over {DIGIT} and under {LONGEST} is needed")
    small_batches(docs.sparkSession)
    new = ["n_bytes", "n_removed", "n_spans", "kept_bytes", "spans"]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in new))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    gone = repeated_runs(plain.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), length, unit)
    lists = gone.groupBy("id").agg(F.collect_list("at").alias("runs"))
    joined = plain.join(lists, plain[key].cast("long") == lists.id, "left").select(F.col(text).alias("t"), "runs", *plain.columns)
    schema = "n_bytes long, n_removed long, n_spans long, kept_bytes binary, spans array<long>, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    out = joined.mapInArrow(_cut(length, unit, len(plain.columns)), schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), *new)
