"""Operator 5, quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, strings

BUCKETS = 1 << 20
#: Rated documents to learn from, about; a fixed hash of the id chooses them.
RATED = 12_000
#: Features in fewer of these documents have no weight.
LEAST = 6
REMEMBERED = 300_000
_letters, _digits, _rest = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"([^a0])\1+")


def word_features(word: str) -> tuple[int, int]:
    """Buckets of a word's letters and digits, and of its shape."""
    core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()
    shape = _rest.sub(r"\1", _digits.sub("0", _letters.sub("a", word)))[:8]
    return zlib.crc32(b"w" + core.encode()) % BUCKETS, zlib.crc32(b"s" + shape.encode()) % BUCKETS


class Words:
    """Features of words, kept per worker."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.table = np.zeros((1 << 12, 2), np.int64)

    def features(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, bucket) pairs, each once: which features each text has."""
        if len(self.number) > REMEMBERED:
            self.number = {}
        words, sizes = [], []
        for t in texts:
            own = (t or b"").split()
            words += own
            sizes.append(len(own))
        new = list(set(words).difference(self.number))
        n = len(self.number)
        while n + len(new) > len(self.table):
            self.table = np.r_[self.table, self.table * 0]
        if new:
            self.table[n : n + len(new)] = [word_features(w.decode(errors="replace")) for w in new]
            self.number.update(zip(new, range(n, n + len(new))))
        own = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        both = self.table[own] + np.repeat(np.arange(len(texts)), sizes)[:, None] * BUCKETS
        pairs = np.unique(both)
        return pairs // BUCKETS, pairs % BUCKETS


def grade_of(quality: str, toxic: str) -> Column:
    """Grades from two ratings: 0 toxic, 1 poor, 2 good; none where they do not tell."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(toxic) == 0, F.when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """P(grade <= k) = sigmoid(cuts[k] - score): one weight vector for all grades, rising cuts between them."""

    weights: np.ndarray
    cuts: np.ndarray

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. top, a column each."""
        return 1 - sigmoid(self.cuts[None, :] - scores[:, None])


def fit(starts: np.ndarray, features: np.ndarray, grades: np.ndarray, top: int, epochs: int = 25, rate: float = 0.3, decay: float = 1e-3) -> Ordinal:
    """Adaptive stochastic gradient descent on the likelihood. starts: where each document's features begin."""
    r = np.random.default_rng(5)
    # Only frequent features are learned, under small numbers; rare ones would fill every bucket with noise.
    often = np.flatnonzero(np.bincount(features, minlength=BUCKETS) >= LEAST)
    small = np.full(BUCKETS, -1)
    small[often] = np.arange(len(often))
    doc = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(features)]))
    known = small[features] >= 0
    sizes = np.bincount(doc[known], minlength=len(starts))
    features, starts, n_features = small[features][known], np.cumsum(sizes) - sizes, len(often)
    w, square = np.zeros(n_features), np.full(n_features, 1e-6)
    share = np.cumsum(np.bincount(grades, minlength=top + 1))[:-1] / len(grades)
    share = np.clip(share, 0.01, 0.99) + np.arange(top) * 1e-6
    cuts = np.log(share / (1 - share))
    low, gaps, moved = cuts[0], np.log(np.maximum(np.diff(cuts), 0.1)), np.full(top, 1e-6)
    for _ in range(epochs):
        order = r.permutation(len(grades))
        for first in range(0, len(order), 32):
            some = order[first : first + 32]
            n = sizes[some]
            at = np.arange(n.sum()) + np.repeat(starts[some] - (np.cumsum(n) - n), n)
            f, doc = features[at], np.repeat(np.arange(len(some)), n)
            score = np.bincount(doc, w[f], len(some))
            cuts = low + np.r_[0, np.cumsum(np.exp(gaps))]
            y = grades[some]
            upper = np.where(y < top, sigmoid(cuts[np.minimum(y, top - 1)] - score), 1.0)
            lower = np.where(y > 0, sigmoid(cuts[np.maximum(y - 1, 0)] - score), 0.0)
            p = np.maximum(upper - lower, 1e-9)
            pull = -(1 - upper - lower)  # of the log likelihood, by the score
            g = np.bincount(f, pull[doc], n_features) / len(some) - decay * w
            square += g * g
            w += rate * g / np.sqrt(square)
            by_cut = np.bincount(np.minimum(y, top - 1), np.where(y < top, upper * (1 - upper) / p, 0), top) - np.bincount(np.maximum(y - 1, 0), np.where(y > 0, lower * (1 - lower) / p, 0), top)
            g = np.r_[by_cut.sum(), np.exp(gaps) * np.cumsum(by_cut[::-1])[::-1][1:]] / len(some)
            moved += g * g
            change = rate * g / np.sqrt(moved)
            low, gaps = low + change[0], gaps + change[1:]
    weights = np.zeros(BUCKETS, np.float32)
    weights[often] = w
    return Ordinal(weights, low + np.r_[0, np.cumsum(np.exp(gaps))])


def learn(docs: DataFrame, ratings: DataFrame, rated: int = RATED) -> Ordinal | None:
    """Learn from about `rated` rated documents; None if there are fewer than two grades."""
    ratings = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    n = ratings.count()
    if not n:
        return None
    chosen = ratings.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1, rated / n)))

    def run(batches):
        words = Words()
        for block in blocks(batches, 2 << 20):
            number, feature = words.features(strings(block.column("text")))
            own = [x.tobytes() for x in np.split(feature.astype(np.int32), np.searchsorted(number, np.arange(1, block.num_rows)))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("grade"), pa.array(own, pa.binary())], names=["doc_id", "grade", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, features binary").collect()
    rows = sorted(rows)
    grades = np.array([r.grade for r in rows], np.int64)
    if len(np.unique(grades)) < 2:
        return None
    own = [np.frombuffer(r.features, np.int32) for r in rows]
    sizes, features = np.array([len(x) for x in own]), np.concatenate(own)
    return fit(np.cumsum(sizes) - sizes, features, grades, int(grades.max()))


def grade_documents(docs: DataFrame, ratings: DataFrame, rated: int = RATED, least: float = 0.5) -> DataFrame:
    """Expected grade and tail probability of every whole text, by a model that learns from ratings (doc_id, grade: 0 is worst).

    Returns doc_id, expected_grade, tail_prob (of the highest grade) and kept
    (tail_prob >= least). Null and empty texts have no features, so the
    thresholds alone decide. Rows with a null or repeated doc_id are graded
    like others; of several ratings of a document the worst counts. With no
    ratings, or only one grade, all is null and everything is kept.
    Other columns are ignored. The sample to learn from is bounded by `rated`.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, ratings, rated))

    def run(batches):
        model, words = sent.value, Words()
        for block in blocks(batches, 1 << 20):
            n = block.num_rows
            if model is None:
                expected, tail, kept = pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array([True] * n)
            else:
                number, feature = words.features(strings(block.column("text")))
                above = model.at_least(np.bincount(number, model.weights[feature], n))
                expected, tail, kept = pa.array(above.sum(1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= least)
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), expected, tail, kept], names=["doc_id", "expected_grade", "tail_prob", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, tail_prob double, kept boolean")
