"""Operator 2, quality scores: hashed word n-grams, logistic regression, FTRL updates.

A text's words are its runs of letters, of digits and of other signs, as they are written (case
kept). Features are the words and word pairs, hashed into 2^18 places; a place's value is its
count over the length of the count vector, and pairs that recur 4, 16, 64 ... times in the text
each add a feature for that, whatever the words are. The score is the logistic function of the
sparse dot product with the weights.

Weights come from follow-the-regularised-leader updates (per-coordinate rates, L1 and L2 terms)
over a bounded sample of the labelled ids: at most ``sample_rows`` of them, those with the
smallest hashes, in that order, ``epochs`` times, in one task whose size the bound fixes: each id
teaches once, by its text of the smallest hash, however often it is listed. The
result, at most 2^18 weights, goes with the scoring function; scoring reads every text once and
shuffles nothing.

Defined cases: null and empty texts have no features and score by the bias alone; rows whose label
is neither 0 nor 1 teach nothing, and of differing labels for one id the mean decides; without a
usable label nothing can be rejected and every score is 1; repeated rows score alike; an empty
table gives no rows; all columns of ``docs`` are kept, and ``score`` replaces one of that name.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, with_workers

BITS = 18
BATCH_ROWS = 512  #: texts and their features held at once, beside those that training keeps
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_HASHES: dict[str, int] = {}
_MULT = np.uint64(0x9E3779B97F4A7C15)  #: 2^64 over the golden ratio, for multiplicative hashing


def _hash(word: str) -> int:
    h = _HASHES.get(word)
    if h is None:
        if len(_HASHES) > 400_000:
            _HASHES.clear()
        h = _HASHES[word] = zlib.crc32(word.encode())
    return h


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text."""
    words = np.array(list(map(_hash, _WORD.findall(text))), dtype=np.uint64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    pairs = (words[:-1] * np.uint64(0x100000001B3) ^ words[1:]) + np.uint64(1 << 40)
    shift = np.uint64(64 - BITS)
    places = np.concatenate([words * _MULT >> shift, pairs * _MULT >> shift]).astype(np.int64)
    place, count = np.unique(places, return_counts=True)
    value = (count / math.sqrt(float(np.dot(count, count)))).astype(np.float32)
    if len(pairs) and (most := np.unique(pairs, return_counts=True)[1].max()) >= 4:
        marks = np.arange(1, int(math.log(most, 4)) + 1)
        place = np.concatenate([place, np.array([zlib.crc32(b"recurs %d" % k) >> (32 - BITS) for k in marks])])
        value = np.concatenate([value, np.full(len(marks), 0.5, np.float32)])
    return place, value


class Ftrl:
    """Follow-the-regularised-leader, proximal, for logistic loss; the last place is the bias."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, 1 << BITS), np.append(x, np.float32(1))
        w = self.weights(at)
        g = (_sigmoid(float(w @ x)) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        np.add.at(self.z, at, g - sigma * w)
        np.add.at(self.n, at, g * g)


def _sigmoid(s: float) -> float:
    return 1 / (1 + math.exp(-s)) if s >= 0 else 1 - 1 / (1 + math.exp(s))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label may be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _described(batches):
    """A text's features as bytes: 32-bit places and values."""
    import pyarrow as pa

    for batch in batches:
        found = [features(t.as_py()) for t in batch.column("t")]
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in ("own_id", "place", "label")), pa.array([at.astype("<i4").tobytes() for at, _ in found], pa.binary()),
            pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())], ["own_id", "place", "label", "at", "x"])


def _train(epochs: int, sample_features: int):
    def run(batches):
        import pyarrow as pa

        model, rows, held = Ftrl(), [], 0
        for batch in batches:
            for at, x, label in zip(*(batch.column(c).to_pylist() for c in ("at", "x", "label")), strict=True):
                held += len(at) // 4
                if held <= sample_features:  # the rows come by hash: those past the bound are a fixed few
                    rows.append((np.frombuffer(at, "<i4"), np.frombuffer(x, "<f4"), label))
        for _ in range(epochs):
            for at, x, label in rows:
                model.learn(at, x, label)
        if rows:
            w = model.weights(np.arange((1 << BITS) + 1))
            place = np.append(np.flatnonzero(w[:-1]), 1 << BITS)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(w[place], pa.float64())], ["place", "weight"])
    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        sample_rows: int = 16_000, epochs: int = 3, sample_features: int = 100_000_000) -> np.ndarray:
    """Weights by place, the bias last; empty if there is nothing to learn from. The one training task holds
    features only, of 8 bytes, at most ``sample_features`` of at most ``sample_rows`` texts."""
    with_workers(docs.sparkSession)
    usable = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).alias("own_id")).agg(F.round(F.avg(label_col)).cast("int").alias("label")))
    order = F.xxhash64("own_id")
    sample = usable.orderBy(order, "own_id").limit(sample_rows)  # at most sample_rows pairs of numbers
    rows = (docs.select(F.col(id_col).alias("own_id"), text_or_empty(text_col).alias("t"))
            .join(F.broadcast(sample), "own_id")
            .groupBy("own_id", "label").agg(F.min(F.struct(F.xxhash64("t"), "t"))["t"].alias("t"))
            .select(F.col("own_id").cast("string").alias("own_id"), order.alias("place"), "label", "t"))
    described = rows.mapInArrow(_described, "own_id STRING, place LONG, label INT, at BINARY, x BINARY")
    with small_batches(docs.sparkSession, BATCH_ROWS):
        found = (described.repartition(1).sortWithinPartitions("place", "own_id")
                 .mapInArrow(_train(epochs, sample_features), "place INT, weight DOUBLE").collect())
    if not found:
        return np.zeros(0)
    weights = np.zeros((1 << BITS) + 1)
    weights[[r.place for r in found]] = [r.weight for r in found]
    return weights


def _score_batches(weights: np.ndarray, text_at: int, kept: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(text_at):
                at, x = features(text.as_py() or "")
                out.append(_sigmoid(float(weights[at] @ x + weights[-1])) if len(weights) else 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(out, pa.float64())], [*batch.schema.names[:kept], "score"])
    return run


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, 0 to 1: higher where label 1 is likelier."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    with_workers(docs.sparkSession)
    kept = docs.drop("score")
    schema = StructType([*kept.schema.fields]).add("score", DoubleType())
    sparse = weights.astype(np.float32)
    n = len(kept.columns)
    texts = [i for i, f in enumerate(kept.schema.fields) if f.name == text_col and f.dataType == StringType()]
    if len(texts) == 1:
        return kept.mapInArrow(_score_batches(sparse, texts[0], n), schema)  # a batch holds its texts once
    own = "_text"  # the last column, under a name that no other has
    while own in map(str.lower, kept.columns):
        own += "_"
    return kept.select("*", text_or_empty(text_col).alias(own)).mapInArrow(_score_batches(sparse, n, n), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fitting) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1: keep)."""
    scored = score(docs, fit(docs, labels, **fitting), fitting.get("text_col", "text"))
    return (scored.withColumn("held_out", held_out(fitting.get("id_col", "doc_id")))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
