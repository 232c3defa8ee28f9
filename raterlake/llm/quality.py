"""Quality classifier: a factorisation machine over words, structure and length.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),
so all pairs of features count at a cost linear in the features. Features are
hashed words (weight: square root of the word's share of the text) and binned
statistics of the whole text: length, letters, capitals, digits, punctuation,
repeated words and lines, word lengths.

The machine is fitted on the driver on a bounded sample of labelled rows
(``train_rows``); scoring reads every text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlake.llm import kernels as K
from raterlake.llm.store import small_batches

WORD_BITS = 15
BINS = 24
#: Labelled rows that the machine is fitted on at most.
TRAIN_ROWS = 8000

_CLASSES = np.zeros((256, 7), np.int32)
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = [_b < 128 and _c.isupper(), _b < 128 and _c.islower(), _b < 128 and _c.isdigit(), _b >= 128, _b < 128 and not _c.isalnum() and not _c.isspace(), _b == 10, _b in (9, 11, 12, 13, 32)]
N_STATS = 14
SIZE = (1 << WORD_BITS) + N_STATS * BINS


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their values, and the offsets of the documents in them."""
    docs = len(offsets) - 1
    words, by_doc, starts, ends = K.word_hashes(data, offsets)
    doc_of = np.repeat(np.arange(docs), np.diff(by_doc))
    n_bytes, n_words = np.diff(offsets).astype(np.float64), np.diff(by_doc).astype(np.float64)
    counts = [_per_doc(_CLASSES[data, c], offsets) for c in range(_CLASSES.shape[1])]
    upper, lower, digit, high, other, lines, blank = counts
    bucket = (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, times = np.unique((doc_of << WORD_BITS) | bucket, return_counts=True)
    doc, word = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    distinct = np.bincount(doc, minlength=docs)
    most = np.zeros(docs)
    np.maximum.at(most, doc, times)
    last = ~np.isin(data[ends - 1], np.frombuffer(b".,;:", np.uint8)) & (_CLASSES[data[ends - 1], 4] > 0) if len(ends) else np.zeros(0, bool)
    alone = (ends - starts == 1) & (_CLASSES[data[starts], 4] > 0) if len(starts) else np.zeros(0, bool)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (doc_of[1:] == doc_of[:-1])
    total = K.prefix(data)
    at = np.flatnonzero(data == 10)
    line_starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], at[at + 1 < len(data)] + 1).astype(np.int64)
    line_ends = np.append(line_starts[1:], len(data)).astype(np.int64)
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    hashed = K.span_hash(total, line_starts, line_ends) if len(line_starts) else np.zeros(0, np.uint64)
    n_lines = np.bincount(line_doc, minlength=docs)
    fresh = np.unique(np.stack([line_doc.astype(np.uint64), hashed]), axis=1)[0].astype(np.int64) if len(hashed) else np.zeros(0, np.int64)
    stats = [
        np.log2(n_bytes + 1) / 24,
        np.log2(n_words + 1) / 20,
        _share(upper, upper + lower),
        _share(digit, n_bytes) * 4,
        _share(high, n_bytes) * 2,
        _share(other, n_bytes) * 3,
        _share(lines, n_bytes) * 20,
        _share(n_bytes - blank, n_words) / 24,
        _share(distinct, n_words),
        _share(most, n_words),
        _share(_per_doc(last, by_doc), n_words),
        _share(_per_doc(alone, by_doc), n_words) * 2,
        _share(_per_doc(again, by_doc), n_words) * 2,
        _share(np.bincount(fresh, minlength=docs), n_lines),
    ]
    binned = np.stack([np.clip((s * BINS).astype(np.int64), 0, BINS - 1) + (1 << WORD_BITS) + j * BINS for j, s in enumerate(stats)], axis=1)
    index = np.concatenate([word, binned.ravel()])
    value = np.concatenate([np.sqrt(times / n_words[doc]), np.full(binned.size, 0.5)])
    owner = np.concatenate([doc, np.repeat(np.arange(docs), N_STATS)])
    order = np.argsort(owner, kind="stable")
    return index[order], value[order].astype(np.float32), np.searchsorted(owner[order], np.arange(docs + 1))


class Machine:
    """Factorisation machine with logistic loss, fitted by Adagrad on small batches."""

    def __init__(self, size: int = SIZE, rank: int = 6, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.02, (size, rank)).astype(np.float32)

    def raw(self, index: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Every document has the statistics' features, so no range is empty."""
        if len(offsets) == 1:
            return np.zeros(0)
        at = offsets[:-1]
        crossed = value[:, None] * self.v[index]
        summed = np.add.reduceat(crossed, at)
        return self.bias + np.add.reduceat(value * self.w[index], at) + 0.5 * (summed**2 - np.add.reduceat(crossed**2, at)).sum(axis=1)

    def score(self, index: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(index, value, offsets), -30, 30)))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 4) -> Machine:
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full(len(self.w), 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for b in range(0, len(order), batch):
                rows = order[b : b + batch]
                index, value = (np.concatenate([docs[r][i] for r in rows]) for i in (0, 1))
                sizes = np.array([len(docs[r][0]) for r in rows])
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                error = self.score(index, value, offsets) - labels[rows]
                each = np.repeat(error, sizes).astype(np.float32) / len(rows)
                summed = np.repeat(np.add.reduceat(value[:, None] * self.v[index], offsets[:-1]), sizes, axis=0)
                used, place = np.unique(index, return_inverse=True)
                dw = np.bincount(place, each * value, len(used)).astype(np.float32) + decay * self.w[used]
                grad = each[:, None] * value[:, None] * (summed - value[:, None] * self.v[index])
                dv = np.stack([np.bincount(place, grad[:, f], len(used)) for f in range(grad.shape[1])], axis=1).astype(np.float32) + decay * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                gb += float(error.mean()) ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                self.bias -= rate * float(error.mean()) / gb**0.5
        return self


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in K.text_runs(batch.column(1)):
            index, value, at = features(data, offsets)
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (index.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *lists], names=["label", "index", "value"])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Machine = shared.value
        for batch in batches:
            for lo, hi, data, offsets in K.text_runs(batch.column(0)):
                score = machine.score(*features(data, offsets))
                yield pa.RecordBatch.from_arrays([pa.array(score, pa.float64()), *(batch.column(1 + c).slice(lo, hi - lo) for c in range(batch.num_columns - 1))], names=["score", *batch.schema.names[1:]])

    return run


def held_out(column: str, parts: int, part: int) -> F.Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == part, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on at most ``train_rows`` labelled rows that are not held out, the first by a hash of their id; of rows that repeat an id the least text."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, 3, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    once = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # rows that repeat an id count once
    rows = once.select("label", "text").mapInArrow(_extract, "label int, index array<int>, value array<float>")
    table = rows.toArrow()
    docs_in = [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(table["index"], table["value"], strict=True)]
    machine = Machine()
    if docs_in:
        order = sorted(range(len(docs_in)), key=lambda r: (len(docs_in[r][0]), docs_in[r][0].tobytes()))
        machine.fit([docs_in[r] for r in order], table["label"].to_numpy()[order].astype(np.float64))
    return machine


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """All columns of ``docs`` and held_out, score (0 to 1), predicted (1 if score >= 0.5).

    A null text is scored as an empty one. Labels other than 0 and 1 and labels of
    unknown documents are ignored; without any label every score is 0.5. New
    columns replace columns of their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    machine = fitted(docs, labels, id_col, text_col, train_rows=train_rows)
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("held_out", "score", "predicted")))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = f"c{docs.columns.index(text_col)}"
    schema = "score double, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    out = plain.select(F.col(text).alias("t"), *plain.columns).mapInArrow(_scored(spark.sparkContext.broadcast(machine)), schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), "score").select("*", held_out(id_col, 3, 1).alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("predicted"))
