"""Language identification by a byte convolutional network.

A text is cut into windows of a fixed number of bytes. Filters of several widths
run over a window's bytes, each keeps its largest answer (max pooling), and a
softmax over these gives the languages' probabilities. On one-hot bytes a filter
of width w is the sum of w table look-ups, so batches of windows need no large
products. A text's log-probabilities are the means over its windows, every byte
counted. The network is trained in numpy on a bounded number of texts a language,
all windows of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlake.llm import kernels as K
from raterlake.llm.quality import held_out
from raterlake.llm.store import small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Texts a language that the network is trained on at most.
TRAIN_TEXTS = 500


def folded(data: np.ndarray) -> np.ndarray:
    """Capitals of ASCII and of the Latin-1 letters (bytes after 0xC3) as small letters."""
    data = K._LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    high = after & (data >= 0x80) & (data <= 0x9E)
    return np.where(high, data + np.uint8(0x20), data)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, WINDOW) bytes, filled with zeros; each window's document and how many bytes of it are text."""
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), per)
    first = np.cumsum(per) - per
    begin = offsets[doc] + (np.arange(len(doc)) - first[doc]) * WINDOW
    filled = np.minimum(offsets[doc + 1] - begin, WINDOW)
    out = np.zeros((len(doc), WINDOW), np.uint8)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    out[:] = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin]
    out[np.arange(WINDOW)[None, :] >= filled[:, None]] = 0
    return out, doc, filled


class Network:
    """tables[k][j]: what byte b at place j adds to each filter of the k-th width."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def pooled(self, x: np.ndarray, places: bool = False):
        """Largest answer of each filter in each window, and where it was."""
        best, where = [], []
        for tables, bias in zip(self.tables, self.bias, strict=True):
            n = x.shape[1] - len(tables) + 1
            answer = np.take(tables[0], x[:, :n], axis=0)
            for j in range(1, len(tables)):
                answer += np.take(tables[j], x[:, j : j + n], axis=0)
            if places:
                where.append(answer.argmax(axis=1))
            best.append(np.maximum(answer.max(axis=1) + bias, 0))
        return np.concatenate(best, axis=1), where

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """In batches that fit a processor's cache."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        for at in range(0, len(x), 32):
            out[at : at + 32] = self.pooled(x[at : at + 32])[0] @ self.out
        out += self.out_bias
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.05, seed: int = 8) -> Network:
        """Adagrad on the cross-entropy; only the place of a filter's largest answer learns."""
        rng = np.random.default_rng(seed)
        state = [np.full_like(t, 1e-2) for t in (*self.tables, *self.bias, self.out, self.out_bias)]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                own = x[rows]
                hidden, where = self.pooled(own, places=True)
                logits = hidden @ self.out + self.out_bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                back = (p @ self.out.T) * (hidden > 0)
                grads = []
                for k, tables in enumerate(self.tables):
                    g = np.zeros_like(tables)
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(len(tables)):
                        byte = np.take_along_axis(own, where[k] + j, axis=1)
                        np.add.at(g[j], (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), part)
                    grads.append(g)
                grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
                grads += [hidden.T @ p, p.sum(axis=0)]
                for value, g, s in zip((*self.tables, *self.bias, self.out, self.out_bias), grads, state, strict=True):
                    s += g * g
                    value -= rate * g / np.sqrt(s)
        return self


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network: Network = shared.value
        for batch in batches:
            for lo, hi, data, offsets in K.text_runs(batch.column(1)):
                x, doc, filled = windows(folded(data), offsets)
                total = np.zeros((hi - lo, len(network.languages)))
                np.add.at(total, doc, network.log_probabilities(x) * (filled[:, None] / WINDOW))
                weight = np.maximum(np.bincount(doc, filled / WINDOW, hi - lo), 1)
                mean = total / weight[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([network.languages[b] for b in best], pa.string()), pa.array(p[np.arange(hi - lo), best], pa.float64()), batch.column(2).slice(lo, hi - lo)], names=["id", "lang_pred", "score", "letters"])

    return run


#: Windows that a text teaches with at most, drawn from all of it, and texts of all languages together; the driver gets that many windows.
TEXT_WINDOWS, MOST_TEXTS = 32, 20_000


def _drawn(doc: np.ndarray, keys: list[int]) -> np.ndarray:
    """Places of the windows that teach: all of a text, or TEXT_WINDOWS of them, drawn by its key."""
    starts = np.searchsorted(doc, np.arange(len(keys) + 1))
    places = []
    for k, lo, hi in zip(keys, starts[:-1], starts[1:], strict=True):
        own = np.arange(lo, hi)
        places.append(own if len(own) <= TEXT_WINDOWS else np.sort(np.random.default_rng(abs(k)).permutation(own)[:TEXT_WINDOWS]))
    return np.concatenate(places) if places else np.zeros(0, np.int64)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each text, and two short pieces, as short texts are windows filled with zeros."""
    for batch in batches:
        langs, keys = batch.column(0), batch.column(1).to_pylist()
        for lo, hi, data, offsets in K.text_runs(batch.column(2)):
            x, doc, _ = windows(folded(data), offsets)
            first = np.searchsorted(doc, np.arange(hi - lo))
            pieces = np.repeat(first, 2)
            short = x[pieces]
            sizes = np.concatenate([np.random.default_rng(abs(k)).integers(6, 100, 2) for k in keys[lo:hi]])
            short[np.arange(WINDOW)[None, :] >= sizes[:, None]] = 0
            drawn = _drawn(doc, keys[lo:hi])
            of = pa.array(lo + np.concatenate([doc[drawn], doc[pieces]]))
            rows = np.concatenate([x[drawn], short])
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WINDOW), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))])
            yield pa.RecordBatch.from_arrays([langs.take(of), flat.cast(pa.binary())], names=["lang", "window"])


def training_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, texts: int) -> DataFrame:
    """(lang, key, text) of at most ``texts`` texts a language, the first by a hash of their id among those not held out.

    Each language is first cut down by a bound on the hash that leaves somewhat
    more rows than wanted, so that no task ranks a whole language. Rows that
    repeat an id count once, by their least text.
    """
    usable = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != "") & F.col(id_col).isNotNull()
    known = docs.where(usable & ~held_out(id_col, 4, 2)).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("long")).alias("key"), F.col(text_col).alias("text"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n"))  # ids, as rows that repeat one count once
    place = F.shiftrightunsigned("key", 11) / F.lit(2.0**53)
    few = known.select("lang", "key").join(F.broadcast(counts) if counts.count() <= BROADCAST_LANGS else counts, "lang").where(place * F.col("n") < 2 * texts + 100).select("lang", "key").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("key", 11), "key"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= texts).select("lang", "key")
    return known.join(F.broadcast(chosen) if counts.count() <= BROADCAST_LANGS else chosen, ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))


#: Up to so many languages, their counts and the keys of the chosen texts go to every task.
BROADCAST_LANGS = 1_000


def fitted(docs: DataFrame, id_col: str, text_col: str, lang_col: str, texts: int = TRAIN_TEXTS) -> Network | None:
    """A network trained on windows of training_texts(); None if there are none. With very many languages each has fewer texts, so that all have MOST_TEXTS at most."""
    languages = docs.where(F.col(lang_col).isNotNull()).agg(F.approx_count_distinct(lang_col)).first()[0]
    chosen = training_texts(docs, id_col, text_col, lang_col, max(1, min(texts, MOST_TEXTS // max(1, languages)))).select("lang", "key", "text")
    table = chosen.mapInArrow(_sampled, "lang string, window binary").toArrow()
    if not table.num_rows:
        return None
    x = np.frombuffer(b"".join(table["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    languages = sorted(set(table["lang"].to_pylist()))
    y = np.searchsorted(languages, table["lang"].to_pylist())
    order = np.lexsort((x.view(f"S{WINDOW}").ravel(), y))  # the same order whatever the partitions
    return Network(languages).train(x[order], y[order])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """(id, held_out, lang_pred, score): one row a document.

    ``und`` with score 0 if the text is null or has no letter, or if there is
    nothing to learn from. Repeated rows are predicted each; a null id is not held
    out and teaches nothing. Other columns are ignored, whatever their names. The
    network learns from at most ``train_texts`` texts a language and TEXT_WINDOWS windows a text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    network = fitted(docs, id_col, text_col, lang_col, train_texts)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), letters.alias("letters"))
    if network is None:
        out = rows.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("letters"))
    else:
        out = rows.mapInArrow(_scored(spark.sparkContext.broadcast(network)), "id long, lang_pred string, score double, letters boolean")
    return out.select(F.col("id").alias(id_col), held_out("id", 4, 2).alias("held_out"), F.when(F.col("letters"), F.col("lang_pred")).otherwise(F.lit("und")).alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(F.lit(0.0)).alias("score"))
