"""Masked pseudo-likelihood scores of documents.

A word is predicted from the REACH words on either side, itself masked: a
network adds a vector for each neighbour by its place, applies tanh, and gives the
word's probability as a product of three. First the class, by a softmax: one of the
commonest words of the corpus, or for all other words their shape (length,
capitals, digits, marks, letters beyond ASCII). Then, for a shape, a digit of the
word's hash, by a softmax that starts from the digits' shares in the corpus. Then
the word's own share of the corpus' words of that shape and digit, smoothed so that a
word never seen has some. So the probabilities of all words add up to one. The
neighbours are told apart by class and digit. The sum of the conditional
log-probabilities of all its words, each given both sides, is a document's score.

Everything is gathered from all documents: the word counts by a shuffle with
pre-aggregation (the commonest words' counts, up to HEAD words, go to every task; all
others are looked up by a join on the word, so the vocabulary has no limit), the weights by training in every partition on its own whole texts
and averaging (each partition's weights count by its words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlake.llm import kernels as K
from raterlake.llm.store import settle, small_batches

REACH = 2
WIDTH = 12
#: Classes: the edge of a text, the commonest words, the shapes.
WORDS, SHAPES = 79, 48
CLASSES = 1 + WORDS + SHAPES
#: Digits of a word's hash; a cell is a commonest word, or a shape and a digit.
DIGITS = 32
CELLS = 1 + WORDS + SHAPES * DIGITS
BATCH = 4096
#: Words whose counts go to every task, at most (12 bytes each); the others are joined.
HEAD = 1 << 18
#: Added to every word's count, seen or not.
SMOOTH = 0.5
SIDES = 2 * REACH

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_HIGH = np.array([b >= 128 for b in range(256)])


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0..SHAPES-1: three lengths by capitals or not, digits or not, and marks none, one or two, more."""
    if not len(starts):
        return np.zeros(0, np.int64)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data])])
        return total[ends] - total[starts]

    size = np.digitize(ends - starts, [4, 8])
    capital = np.digitize(count(_UPPER), [1, 2])
    digit = count(_DIGIT) > 0
    mark = np.digitize(count(_MARK), [1, 3])
    kind = np.where(digit, 3, np.where(count(_HIGH) > 0, 2, np.where(capital == 2, 1, 0)))
    out = (size * 4 + kind) * 4 + np.where(mark == 2, 3, np.where(mark == 1, 2, np.minimum(capital, 1)))
    return out.astype(np.int64)


def digits(words: np.ndarray) -> np.ndarray:
    return ((words >> np.uint64(40)) % np.uint64(DIGITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in K.text_runs(batch.column(0)):
            words, _, starts, ends = K.word_hashes(data, offsets, lower=False)
            values, first, times = np.unique(words, return_index=True, return_counts=True)
            shape = shapes(data, starts[first], ends[first])
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(shape.astype(np.int32)), pa.array(times)], names=["word", "shape", "n"])


class Vocabulary:
    """Cells of words, and the log-probability of a word inside its cell.

    ``total`` and ``distinct`` (SHAPES, DIGITS) count the words beside the commonest; ``head`` (word, n) are those whose counts are at hand.
    """

    def __init__(self, common: list[int], total: np.ndarray, distinct: np.ndarray, head: tuple[np.ndarray, np.ndarray]):
        values = np.array(common, np.int64).view(np.uint64)
        self.order = np.argsort(values)
        self.words = values[self.order]
        self.whole = np.log(total + SMOOTH * (distinct + 1)).ravel()
        mass = total + SMOOTH * (distinct + 1)
        self.prior = np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32)
        words, n = head[0].view(np.uint64), np.asarray(head[1], np.float64)
        order = np.argsort(words)
        self.head, self.weight = words[order], np.log(n[order] + SMOOTH).astype(np.float32)

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, offsets by document, hashes."""
        words, by_doc, starts, ends = K.word_hashes(data, offsets, lower=False)
        out = 1 + WORDS + shapes(data, starts, ends) * DIGITS + digits(words)
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            known = self.words[at] == words
            out[known] = 1 + self.order[at[known]]
        return out, by_doc, words

    def inside(self, cells: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each word inside its cell, and the places of words whose count has to be joined; there, log(count + SMOOTH) is to be added."""
        out = np.zeros(len(words))
        rare = np.flatnonzero(cells > WORDS)
        out[rare] = -self.whole[cells[rare] - 1 - WORDS]
        if not len(self.head):
            return out, rare
        own = words[rare]
        at = np.minimum(np.searchsorted(self.head, own), len(self.head) - 1)
        found = self.head[at] == own
        out[rare[found]] += self.weight[at[found]]
        return out, rare[~found]


def contexts(classes: np.ndarray, by_doc: np.ndarray) -> np.ndarray:
    """(words, SIDES): the cells around each word; 0 beyond a text's ends."""
    n, sizes = len(classes), np.diff(by_doc)
    place = np.arange(n) - np.repeat(by_doc[:-1], sizes)
    left = np.repeat(sizes, sizes) - 1 - place
    padded = np.concatenate([np.zeros(REACH, np.int64), classes, np.zeros(REACH, np.int64)])
    columns = []
    for step in (*range(-REACH, 0), *range(1, REACH + 1)):
        value = padded[REACH + step : REACH + step + n]
        columns.append(np.where(place >= -step if step < 0 else left >= step, value, 0))
    return np.stack(columns, axis=1) if n else np.zeros((0, SIDES), np.int64)


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


class Network:
    """``prior`` (SHAPES, DIGITS) are the log-shares of the digits, which are not trained."""

    SIZES = (SIDES * CELLS * WIDTH, WIDTH, WIDTH * CLASSES, CLASSES, WIDTH * DIGITS)

    def __init__(self, prior: np.ndarray, weights: np.ndarray | None = None, seed: int = 12):
        self.prior = prior
        if weights is None:
            rng = np.random.default_rng(seed)
            weights = np.concatenate([rng.normal(0, spread, n) for n, spread in zip(self.SIZES, (0.1, 0, 0.1, 0, 0.1), strict=True)])
        near, self.lift, out, self.bias, fine = np.split(weights.astype(np.float32), np.cumsum(self.SIZES)[:-1])
        self.near, self.out, self.fine = near.reshape(SIDES * CELLS, WIDTH), out.reshape(WIDTH, CLASSES), fine.reshape(WIDTH, DIGITS)

    def weights(self) -> np.ndarray:
        return np.concatenate([self.near.ravel(), self.lift, self.out.ravel(), self.bias, self.fine.ravel()])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = np.take(self.near, around[:, 0], axis=0)
        for s in range(1, SIDES):
            h += np.take(self.near, around[:, s] + s * CELLS, axis=0)
        h += self.lift
        return np.tanh(h, out=h)

    @staticmethod
    def parts(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes; the rows of words beside the commonest, their shapes and digits."""
        rare = np.flatnonzero(cells > WORDS)
        shape, digit = np.divmod(cells[rare] - 1 - WORDS, DIGITS)
        classes = cells.copy()
        classes[rare] = 1 + WORDS + shape
        return classes, rare, shape, digit

    def log_likelihood(self, around: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Log-probabilities of the words' cells."""
        out = np.empty(len(cells), np.float32)
        for at in range(0, len(cells), BATCH):
            classes, rare, shape, digit = self.parts(cells[at : at + BATCH])
            h = self.hidden(around[at : at + BATCH])
            p = h @ self.out
            p += self.bias
            own = p[np.arange(len(classes)), classes]
            own -= np.log(np.exp(p, out=p).sum(axis=1))
            q = h[rare] @ self.fine
            q += self.prior[shape]
            own[rare] += q[np.arange(len(rare)), digit] - np.log(np.exp(q, out=q).sum(axis=1))
            out[at : at + BATCH] = own
        return out

    def step(self, around: np.ndarray, cells: np.ndarray, rate: float) -> None:
        """One step of gradient ascent on the mean of a batch."""
        n = len(cells)
        classes, rare, shape, digit = self.parts(cells)
        h = self.hidden(around)
        p = h @ self.out
        p += self.bias
        p = _softmax(p)
        p[np.arange(n), classes] -= 1
        p *= rate / n
        few = h[rare]
        q = few @ self.fine
        q += self.prior[shape]
        q = _softmax(q)
        q[np.arange(len(rare)), digit] -= 1
        q *= rate / n
        back = p @ self.out.T
        back[rare] += q @ self.fine.T
        back *= 1 - h * h
        self.out -= h.T @ p
        self.fine -= few.T @ q
        self.bias -= p.sum(axis=0)
        self.lift -= back.sum(axis=0)
        # neighbours' vectors: one product with a sparse table of ones, by sorting
        for s in range(SIDES):
            order = np.argsort(around[:, s], kind="stable")
            value = around[order, s]
            first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            self.near[value[first] + s * CELLS] -= np.add.reduceat(back[order], first, axis=0)


def _trained(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        network, seen = Network(vocabulary.prior, weights), 0
        for batch in batches:
            for _, _, data, offsets in K.text_runs(batch.column(0)):
                cells, by_doc, _ = vocabulary.split(data, offsets)
                around = contexts(cells, by_doc)
                for at in range(0, len(cells), BATCH):
                    own = cells[at : at + BATCH]
                    network.step(around[at : at + BATCH].astype(np.int32), own, 4.0 / (1 + seen / 2e6) ** 0.5 * len(own) / BATCH)
                    seen += len(own)
        if seen:
            weights = network.weights().astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(weights) + 1, dtype=np.int32)), pa.array(np.append(weights, seen))], names=["place", "value"])

    return run


def _head(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest words and their counts, at most HEAD: those from the least count on that leaves so few."""
    step = F.floor(F.log2("n") * 16)
    left, least = HEAD, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():  # some hundred rows
        left -= r["words"]
        if left < 0:
            break
        least = r["n"]
    rows = counts.where(F.col("n") >= least if least is not None else F.lit(False)).select("word", "n").toPandas()
    return rows["word"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def fit(texts: DataFrame) -> tuple[Vocabulary, Network, DataFrame]:
    """Counts and weights from all of ``texts`` (one column, text), and the table of counts (word, shape, n)."""
    spark = texts.sparkSession
    counts = settle(texts.mapInArrow(_counts, "word long, shape int, n long").groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n")))
    common = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    digit = F.pmod(F.shiftrightunsigned("word", 40), F.lit(DIGITS)).cast("int")
    total, distinct = np.zeros((SHAPES, DIGITS)), np.zeros((SHAPES, DIGITS))
    for r in counts.where(~F.col("word").isin(common)).groupBy("shape", digit.alias("digit")).agg(F.count("*").alias("distinct"), F.sum("n").alias("n")).collect():  # SHAPES * DIGITS rows
        total[r["shape"], r["digit"]], distinct[r["shape"], r["digit"]] = r["n"], r["distinct"]
    vocabulary = Vocabulary(common, total, distinct, _head(counts))
    shared = spark.sparkContext.broadcast((vocabulary, Network(vocabulary.prior).weights()))
    gathered = texts.mapInArrow(_trained(shared), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas().sort_values("place")
    if not len(gathered):
        return vocabulary, Network(vocabulary.prior), counts
    value = gathered["value"].to_numpy()
    return vocabulary, Network(vocabulary.prior, value[:-1] / value[-1]), counts


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        network = Network(vocabulary.prior, weights)
        for batch in batches:
            for lo, hi, data, offsets in K.text_runs(batch.column(1)):
                cells, by_doc, words = vocabulary.split(data, offsets)
                inside, rare = vocabulary.inside(cells, words)
                each = network.log_likelihood(contexts(cells, by_doc), cells) + inside
                total = np.concatenate([[0], np.cumsum(each, dtype=np.float64)])
                ends = pa.array(np.searchsorted(rare, by_doc).astype(np.int32))
                rest = pa.ListArray.from_arrays(ends, pa.array(words[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(by_doc).astype(np.int64)), pa.array(total[by_doc[1:]] - total[by_doc[:-1]]), rest], names=["id", "n_words", "log_likelihood", "words"])

    return run


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_likelihood, per_word): one row a document, higher means likelier.

    Words are parted by ASCII white space. A text without words, or null, has
    log_likelihood 0 and per_word null. Repeated rows and rows without an id are
    scored each. Other columns are ignored, whatever their names. Sums of
    floating-point weights may differ in their last digits from run to run.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    vocabulary, network, counts = fit(rows.where("text is not null").select("text"))
    shared = spark.sparkContext.broadcast((vocabulary, network.weights()))
    scored = rows.mapInArrow(_scored(shared), "id long, n_words long, log_likelihood double, words array<long>")
    out = settle(scored.withColumn("row", F.monotonically_increasing_id()))
    rest = out.select("row", F.explode("words").alias("word"))
    count = F.log(F.coalesce("n", F.lit(0)) + SMOOTH)
    added = rest.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(F.sum(count).alias("added"))
    out = out.drop("words").join(added, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("added", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("per_word"))
