"""Quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treecorpus.llm.common import held_out_column, id_back, id_of, logistic, small_batches, training_rows, utf8

#: Training texts per class; buckets of hashed words; cells per statistic; width of the interactions.
PER_CLASS, BUCKETS, CELLS, FACTORS = 2000, 1 << 16, 8, 8
EPOCHS, BATCH, RATE, SHRINK = 12, 64, 0.1, 1e-5
#: Bytes that are letters, digits or white space; the rest of ASCII is punctuation.
_KINDS = np.zeros(256, np.int64)
for _kind, _bytes in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", bytes(range(128, 256))], 1):
    _KINDS[list(_bytes)] = _kind


def features(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, statistics) of a text: its hashed words, and its structure in numbers."""
    words = text.lower().split()
    n, size = len(words), len(text)
    buckets, counts = np.unique(np.fromiter(map(crc32, words), np.int64, n) % BUCKETS, return_counts=True)
    values = np.log1p(counts)
    values = values / max(np.linalg.norm(values), 1e-9)
    kinds = np.bincount(_KINDS[np.frombuffer(text, np.uint8)], minlength=6) / max(size, 1)
    lines = text.split(b"\n")
    seen = Counter(words)
    repeated = sum(a == b for a, b in zip(words, words[1:]))
    endings = sum(w[-1:] in b".!?" for w in words)
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    alone = sum(not any(c > 127 or chr(c).isalnum() for c in w) for w in seen)
    statistics = np.array([
        np.log1p(size), np.log1p(n), len(seen) / max(n, 1), max(seen.values(), default=0) / max(n, 1),
        repeated / max(n, 1), (size - n) / max(n, 1), kinds[0], kinds[2], kinds[3], kinds[5],
        np.log1p(len(lines)), len(set(lines)) / len(lines), endings / max(n, 1), marked / max(n, 1), alone / max(len(seen), 1)])
    return buckets, values, statistics


STATISTICS = 15


def cells_of(statistics: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The feature number of each statistic's cell; statistics are n x STATISTICS."""
    places = np.stack([np.searchsorted(edges[i], statistics[:, i]) for i in range(STATISTICS)], axis=1)
    return BUCKETS + np.arange(STATISTICS) * CELLS + places


class Machine:
    """A second-order factorisation machine for texts with sparse features."""

    def __init__(self, edges: np.ndarray, shift: float = 0.0):
        size = BUCKETS + STATISTICS * CELLS
        self.edges, self.shift = edges, shift
        self.bias = 0.0
        self.weights = np.zeros(size, np.float32)
        self.factors = (np.random.default_rng(3).standard_normal((size, FACTORS)) * 0.02).astype(np.float32)

    def rows(self, buckets, values, statistics):
        """The features of many texts in one row: numbers, values, and where each text begins."""
        cells = cells_of(np.asarray(statistics), self.edges)
        numbers = [np.r_[b, c] for b, c in zip(buckets, cells)]
        weights = [np.r_[v, np.full(STATISTICS, 0.5)] for v in values]
        begin = np.r_[0, np.cumsum([len(x) for x in numbers])[:-1]]
        return np.concatenate(numbers), np.concatenate(weights).astype(np.float32), begin

    def margin(self, numbers, values, begin):
        """Scores in linear time: the square of the sums less the sum of the squares."""
        part = self.factors[numbers] * values[:, None]
        sums = np.add.reduceat(part, begin, axis=0)
        squares = np.add.reduceat(part**2, begin, axis=0)
        linear = np.add.reduceat(self.weights[numbers] * values, begin)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1), sums

    def fit(self, buckets, values, statistics, labels) -> None:
        rng = np.random.default_rng(7)
        seen_w, seen_v, seen_b = np.full(len(self.weights), 1e-3), np.full(self.factors.shape, 1e-3), 1e-3
        for _ in range(EPOCHS):
            order = rng.permutation(len(labels))
            for a in range(0, len(order), BATCH):
                pick = order[a:a + BATCH]
                numbers, x, begin = self.rows([buckets[i] for i in pick], [values[i] for i in pick], statistics[pick])
                margin, sums = self.margin(numbers, x, begin)
                error = logistic(margin) - labels[pick]
                text = np.repeat(np.arange(len(pick)), np.diff(np.r_[begin, len(numbers)]))
                step = (error[text] * x)[:, None]
                gradient_v = step * (sums[text] - self.factors[numbers] * x[:, None])
                which, inverse = np.unique(numbers, return_inverse=True)
                total_w = np.bincount(inverse, step[:, 0]) + SHRINK * self.weights[which]
                total_v = np.zeros((len(which), FACTORS))
                np.add.at(total_v, inverse, gradient_v)
                total_v += SHRINK * self.factors[which]
                seen_w[which] += total_w**2
                seen_v[which] += total_v**2
                seen_b += error.sum() ** 2
                self.weights[which] -= (RATE * total_w / np.sqrt(seen_w[which])).astype(np.float32)
                self.factors[which] -= (RATE * 0.3 * total_v / np.sqrt(seen_v[which])).astype(np.float32)
                self.bias -= RATE * error.sum() / np.sqrt(seen_b)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a in range(0, len(texts), 64):
            found = [features(x) for x in texts[a:a + 64]]
            margin, _ = self.margin(*self.rows(*zip(*found)))
            out[a:a + 64] = logistic(margin + self.shift)
        return out


class Constant:
    """The score where the labels don't hold both classes."""

    def __init__(self, score: float):
        self.score = score

    def scores(self, texts):
        return np.full(len(texts), self.score)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Machine | Constant:
    """A machine fitted on at most ``per_class`` labelled texts of each class; held-out ids take no part.

    Only the features of these texts come to the driver. Their classes are as frequent as the
    bound makes them, so the margin is shifted back to the frequencies of all training labels.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [features(x) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), *(pa.array([np.asarray(f[i], t).tobytes() for f in found], pa.binary())
                                        for i, t in enumerate(("<i4", "<f4", "<f8")))], ["doc_id", "label", "buckets", "values", "statistics"])

    sample = training_rows(docs, labels, label, per_class).mapInArrow(
        run, "doc_id long, label int, buckets binary, values binary, statistics binary").collect()
    sample.sort(key=lambda r: (r.doc_id, bytes(r.buckets), bytes(r.values)))
    known = dict(labels.filter(F.col(label).isin(0, 1) & ~held_out_column(F.col("doc_id"))).groupBy(label).count().collect())
    y = np.array([r.label for r in sample], dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return Constant(float(y.mean()) if len(y) else 0.5)
    statistics = np.array([np.frombuffer(r.statistics, "<f8") for r in sample])
    edges = np.quantile(statistics, np.arange(1, CELLS) / CELLS, axis=0).T
    shift = np.log(known.get(1, 1) / known.get(0, 1)) - np.log(y.sum() / (len(y) - y.sum()))
    machine = Machine(edges, float(shift))
    machine.fit([np.frombuffer(r.buckets, "<i4") for r in sample], [np.frombuffer(r["values"], "<f4") for r in sample], statistics, y)
    return machine


def score(docs: DataFrame, model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, digest, score`` of every row; ``digest`` is the hash of its text (null is empty)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("digest"), pa.array(model.scores(utf8(batch.column("text"))), pa.float64())], ["doc", "digest", "score"])

    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(id_of(id).alias("doc"), F.xxhash64(body).alias("digest"), body.alias("text")).mapInArrow(
        run, "doc long, digest long, score double")


def report(docs: DataFrame, model, threshold: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row: a score for null and empty texts too.

    A row without an id is not held out. Repeated rows are scored alike; columns other than the text
    are never inputs of a score.
    """
    return score(docs, model).select(
        id_back("doc").alias("doc_id"), held_out_column(id_back("doc")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model, threshold: float) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns, in one narrow stage."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            good = model.scores(utf8(batch.column(at))) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
