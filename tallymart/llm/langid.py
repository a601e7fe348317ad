"""Operator 7, language ID: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, map_texts, strings
from .hashing import mix

BUCKETS, WIDTH, GRAMS = 1 << 13, 16, (2, 3, 4)
#: Documents of each language that the model may learn from, about; a quarter of them calibrate it.
PER_LANGUAGE = 600
REMEMBERED = 300_000
#: Share of rightly predicted calibration documents that the rejection may cost.
LOST = 0.001


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, with word ends marked, and how many each word has."""
    text = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    breaks = np.cumsum(text == 10)
    own, found = [], []
    for n in GRAMS:
        if len(text) < n:
            continue
        size = len(text) - n + 1
        value = np.full(size, n, np.uint64)
        for i in range(n):
            value = value * np.uint64(0x100000001B3) + text[i : i + size]
        # Inside one word: at most its own two marks, at the ends.
        first = breaks[:size]
        inner = breaks[n - 2 : n - 2 + size] == first
        own.append(first[inner] - 1)
        found.append((mix(value[inner]) >> np.uint64(20)) % np.uint64(BUCKETS))
    own, found = np.concatenate(own), np.concatenate(found).astype(np.int64)
    order = np.argsort(own, kind="stable")
    return found[order], np.bincount(own, minlength=len(words))[: len(words)]


def lettered(word: str) -> bool:
    return any(map(str.isalpha, word))


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Weight of every bucket in the average over a text's words of the average over a word's n-grams."""
    words = [w for w in text.lower().split() if lettered(w)]
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    found, counts = gram_buckets(words)
    weight = np.bincount(found, np.repeat(1 / counts / len(words), counts), BUCKETS)
    at = np.flatnonzero(weight)
    return at, weight[at].astype(np.float32)


@dataclass
class Model:
    """scores: bucket x language; the average of embeddings and the linear layer are one product."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 30, rate: float = 20.0) -> Model:
    """Stochastic gradient descent over minibatches, then a temperature and a least score from documents kept apart."""
    r = np.random.default_rng(7)
    order = r.permutation(len(x))
    held, own = order[: len(x) // 4], order[len(x) // 4 :]
    k = len(languages)
    embedding = r.normal(0, 0.1, (x.shape[1], WIDTH)).astype(np.float32)
    weight, bias = r.normal(0, 0.3, (WIDTH, k)).astype(np.float32), np.zeros(k, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for first in range(0, len(own), 32):
            some = own[r.permutation(len(own))[:32]] if first else own[:32]
            hidden = x[some] @ embedding
            z = hidden @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = p @ weight.T
            weight -= np.float32(0.05 * step) * (hidden.T @ p)
            bias -= np.float32(0.01 * step) * p.sum(0)
            embedding -= np.float32(step) * (x[some].T @ back)
    model = Model(languages, embedding @ weight, bias, 1.0, 0.0)
    check = held if len(held) >= k else own
    logits = x[check] @ model.scores

    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(np.maximum(model.probabilities(logits)[np.arange(len(check)), y[check]], 1e-9)).mean()

    model.temperature = min((float(t) for t in np.geomspace(0.25, 4, 33)), key=loss)
    p = model.probabilities(logits)
    right = p.argmax(1) == y[check]
    if right.any():
        model.least = float(min(0.5, np.quantile(p.max(1)[right], LOST)))
    return model


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from about `per_language` documents of each language: a fixed hash of the id decides. None without any."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(int(1_000_000 * min(1.0, per_language / n)))) for lang, n in counts.items()), F.lit(0))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    def run(batches):
        for block in blocks(batches, 4 << 20):
            found = [text_features(t.decode(errors="replace")) for t in strings(block.column("text"))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), block.column("lang"), pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], names=["doc_id", "lang", "at", "weight"])

    rows = [r for r in sorted(chosen.mapInArrow(run, "doc_id long, lang string, at binary, weight binary").collect()) if len(r.at)]
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.at, np.int32)] = np.frombuffer(r.weight, np.float32)
    return train(x, np.array([languages.index(r.lang) for r in rows]), languages)


class Reader:
    """Sums of word scores; the scores of words are kept."""

    def __init__(self, model: Model):
        self.model, self.number = model, {}
        self.table = np.zeros((1 << 12, len(model.languages)), np.float32)
        self.counts = np.zeros(1 << 12, np.int64)

    def add(self, words: list[str]) -> None:
        n = len(self.number)
        while n + len(words) > len(self.table):
            self.table, self.counts = np.r_[self.table, self.table * 0], np.r_[self.counts, self.counts * 0]
        self.number.update(zip(words, range(n, n + len(words))))
        real = np.flatnonzero([lettered(w) for w in words])
        if len(real):
            found, counts = gram_buckets([words[i] for i in real])
            sums = np.add.reduceat(self.model.scores[found], np.cumsum(counts) - counts)
            self.table[n + real] = sums / counts[:, None]
            self.counts[n + real] = 1

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Average word scores of each text, and its number of words with letters."""
        if len(self.number) > REMEMBERED:
            self.number = {}
            self.counts[:] = 0
            self.table[:] = 0
        words, sizes = [], []
        for t in texts:
            own = (t or b"").decode(errors="replace").lower().split()
            words += own
            sizes.append(len(own))
        if new := set(words).difference(self.number):
            self.add(list(new))
        own = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        text = np.repeat(np.arange(len(texts)), sizes)
        n = np.bincount(text, self.counts[own], len(texts))
        sums = np.stack([np.bincount(text, self.table[own, j], len(texts)) for j in range(self.table.shape[1])], 1)
        return sums / np.maximum(n, 1)[:, None], n


def predict(docs: DataFrame, model: Model | None, extra: list[str] | None = None) -> DataFrame:
    """Predictions for all rows; the model has a fixed size and is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ready = {}

    def run(batches):
        model = sent.value
        for block in blocks(batches, 1 << 20):
            texts = strings(block.column("text"))
            if model is None:
                lang, score, accepted = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            else:
                reader = ready[0] if ready else ready.setdefault(0, Reader(model))
                logits, n = reader.read(texts)
                p = model.probabilities(logits)
                lang = [model.languages[i] if k else "und" for i, k in zip(p.argmax(1), n)]
                score = np.where(n > 0, p.max(1), 0.0)
                accepted = (n > 0) & (score >= model.least)
            yield block, pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(lang), pa.array(score, pa.float64()), pa.array(accepted)], names=["doc_id", "lang_pred", "score", "accepted"])

    return map_texts(docs, run, "doc_id long, lang_pred string, score double, accepted boolean", extra)


def identify(docs: DataFrame, learn_from: DataFrame, per_language: int = PER_LANGUAGE, extra: list[str] | None = None) -> DataFrame:
    """The language of every whole text, by a model that learns from `learn_from` (doc_id, text, lang).

    Returns doc_id, lang_pred (a learned language, or `und` for a null text or
    one without letters), score (0 to 1, calibrated) and accepted: false for `und` and for
    scores under the level that nearly all rightly predicted documents reach.

    Nothing but the text is an input of a prediction. Rows with a null doc_id
    or repeated ones are predicted like others. Without any labelled text,
    every row is `und`. At most about `per_language` documents of a language
    are learned from, chosen by a hash of the id; all rows are predicted. `extra` columns
    of docs are carried along.
    """
    return predict(docs, learn(learn_from, per_language), extra)


def held_out(doc_id="doc_id"):
    """The quarter of documents that is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
