"""Places where a model can be plugged in, with deterministic defaults that need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 64


def encode(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], vector: str = "vector") -> DataFrame:
    """Adds unit-norm vectors of a text column; load() gives a batch encoder and runs once per worker task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            x = np.asarray(encoder(texts.fillna("").tolist()), np.float32)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.Series(list(x / np.where(norm > 0, norm, 1)))

    return df.withColumn(vector, run(text))


def hashed_tokens() -> Callable[[list[str]], np.ndarray]:
    """Default encoder: signed hashed bags of words."""
    import hashlib
    import re

    word = re.compile(r"\w+")

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), WIDTH))
        for row, text in zip(out, texts):
            for w in word.findall(text.lower()):
                h = int.from_bytes(hashlib.md5(w.encode(), usedforsecurity=False).digest()[:4], "big")
                row[h % WIDTH] += 1 if h & 64 else -1
        return out

    return run


def hashed_embedding(text: str) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        x = hashed_tokens()(texts.fillna("").tolist())
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series(list(x / np.where(norm > 0, norm, 1)))

    return run(text)


def tokenize(text: str, cutter: Callable[[str], list[str]]) -> Column:
    """Tokens by a dictionary segmenter, instead of the built-in ones."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(cutter)

    return run(text)


def score_pairs(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], query: str = "text", doc: str = "rerank_text", score: str = "score") -> DataFrame:
    """Adds scores of (query, text) pairs; equal pairs are scored once per batch."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, docs: pd.Series) -> pd.Series:
        both = pd.DataFrame({"q": queries.fillna(""), "d": docs.fillna("")})
        once = both.drop_duplicates()
        values = dict(zip(zip(once.q, once.d), scorer(once.q.tolist(), once.d.tolist())))
        return pd.Series([values[x] for x in zip(both.q, both.d)], dtype="float64")

    return pairs.withColumn(score, run(query, doc))
