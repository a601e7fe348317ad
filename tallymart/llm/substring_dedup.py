"""Operator 1, substring dedup: Rabin-Karp hashes of every window of `width` words, counted in Spark."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import first_owner as owner
from .common import as_text, covered, text_bytes
from .hashing import BASE, SECOND, window_hashes, word_hashes, word_spans

OUT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string"
WINDOWS_IN_BUCKET, HASHED = 1_200_000, 1 << 20


def window_keys(texts: list[bytes | None], width: int):
    """(text number, first word, hash, second hash) of every window, about HASHED bytes of text at a time."""
    ends = np.cumsum([len(t or b"") for t in texts])
    found, low = [], 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + HASHED, "right")))
        number, *rest = keys_of(texts[low:high], width)
        found.append((number + low, *rest))
        low = high
    return tuple(map(np.concatenate, zip(*found)))


def keys_of(texts: list[bytes | None], width: int):
    data = np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    low, high = word_spans(data)
    number = np.searchsorted(ends, low, "right")
    words, others = word_hashes(data, low, high), word_hashes(data, low, high, SECOND)
    first = np.searchsorted(number, np.arange(len(texts)))
    n = max(0, len(words) - width + 1)
    whole = number[:n] == number[width - 1 :][:n]
    at = np.arange(n) - first[number[:n]]
    return number[:n][whole], at[whole], window_hashes(words, width, BASE)[whole], window_hashes(others, width, SECOND)[whole]


def intervals(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True, as starts and ends."""
    step = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def substring_dedup(docs: DataFrame, width: int = 13) -> DataFrame:
    """Remove each word that lies in a window of `width` words which a document with a smaller doc_id also has.

    Words are runs of bytes other than ASCII white space, unchanged. Windows
    are judged on the input. Returns doc_id, n_words, n_removed, removed
    (maximal word intervals [start, end)) and kept (words left, joined by one
    space) for every row.

    Null and empty texts have no words and an empty kept text. A row with a
    null doc_id is nobody's predecessor and keeps all its words. Rows that
    repeat a doc_id are each returned; as no id is smaller than itself they do
    not remove each other. Other columns of `docs` are ignored.

    Equality of windows is judged by two hashes with different bases, of words and of windows: by all 128
    bits within a block of text, by 64 and the bucket's number (the second hash) across blocks. With w
    windows in b buckets, w * w / b / 2^65 windows are taken for others by chance: 0.05 for 10 TB, 0.5 for 100 TB.
    """
    docs = docs.select("doc_id", "text")
    size = text_bytes(docs)
    buckets, parts = max(24, math.ceil(size / 6 / WINDOWS_IN_BUCKET)), max(48, math.ceil(size / (4 << 20)))
    answers = owner.replies(owner.requests(docs, lambda texts: window_keys(texts, width), buckets), buckets, parts)

    def make(ids, texts, gone):
        n_words, n_removed, removed, kept = [], [], [], []
        for text, starts in zip(texts, gone):
            words = (text or b"").split()
            n_words.append(len(words))
            if len(starts):
                mask = covered(starts, width, len(words))
                n_removed.append(int(mask.sum()))
                removed.append([{"start": s, "end": e} for s, e in zip(*(x.tolist() for x in intervals(mask)))])
                words = [w for w, out in zip(words, mask.tolist()) if not out]
            else:
                n_removed.append(0)
                removed.append([])
            kept.append(b" ".join(words))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "removed": pa.array(removed, span), "kept": as_text(kept)}

    return owner.with_places(docs, answers, parts, make, OUT)
