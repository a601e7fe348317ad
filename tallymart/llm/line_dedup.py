"""Operator 2, line dedup: hashes in range slices, sorted by document and place, streamed once."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import first_owner as owner
from .common import as_text, blocks, strings, text_bytes
from .hashing import SPACES

ROW = pa.schema([("slice", pa.int32()), ("h", pa.int64()), ("g", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int64()), ("known", pa.bool_())])
ROW_SQL = "slice int, h long, g long, doc_id long, line long, known boolean"


def long_enough(key: bytes, least: int) -> bool:
    """At least `least` code points."""
    return len(key) >= 4 * least or len(key) >= least and len(key) - sum(0x80 <= b < 0xC0 for b in key) >= least


def line_rows(docs: DataFrame, least: int, slices: int) -> DataFrame:
    """A row per line that is long enough; `known` marks lines that a smaller document of the same task's block holds too."""
    import xxhash

    width = (1 << 64) // slices + 1

    def run(batches):
        for block in blocks(batches, owner.BLOCK):
            doc, at, found = [], [], []
            for i, text in zip(block.column("doc_id").to_pylist(), strings(block.column("text"))):
                for n, line in enumerate(text.split(b"\n")):
                    if len(line) >= least and long_enough(key := line.strip(SPACES).lower(), least):
                        doc.append(i)
                        at.append(n)
                        found.append(xxhash.xxh3_128_digest(key))
            pair = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
            h, g, doc = pair[:, 0].copy(), pair[:, 1].copy(), np.array(doc, np.int64)
            known = owner.later(h, doc, g)  # decided already: they go anywhere, not to the task of a hot key
            to = np.where(known, doc % slices, (h // np.uint64(width)).astype(np.int64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(doc), pa.array(np.array(at, np.int64)), pa.array(known)], schema=ROW)

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, ROW_SQL)


def dropped(rows: DataFrame, tasks: int, parts: int) -> DataFrame:
    """Stream sorted rows: every line but those of a key's first document, packed by part of documents."""

    def run(batches):
        last, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, g, doc, at = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("h", "g", "doc_id", "line"))
            starts = np.flatnonzero(np.r_[(h[0], g[0]) != last, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            begins = np.r_[first, doc[starts]] if not len(starts) or starts[0] else doc[starts]
            edges = np.r_[0, starts] if not len(starts) or starts[0] else starts
            least = np.repeat(begins.astype(np.int64), np.diff(np.r_[edges, len(h)]))
            last, first = (h[-1], g[-1]), least[-1]
            gone = (doc != least) | batch.column("known").to_numpy(zero_copy_only=False)
            if gone.any():
                yield from owner.reply_rows(doc[gone], at[gone], parts).to_batches()

    return rows.repartition(tasks, "slice").sortWithinPartitions("h", "g", "doc_id", "line").mapInArrow(run, owner.REPLY_SQL)


def line_dedup(docs: DataFrame, least: int = 10, text: bool = False, extra: list[str] | None = None) -> DataFrame:
    """Drop repeated lines from all documents but the one with the smallest doc_id that holds them.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased;
    keys under `least` code points always stay. Returns doc_id, n_lines,
    n_dropped and keep: a zlib-compressed bitmap with a bit per line, highest
    bit first. With `text`, also kept: the lines left, joined by newlines. `extra`
    columns of docs are carried along.

    Null and empty texts are one empty line, which stays. A row with a null
    doc_id keeps all lines and takes none from others. Rows that repeat a
    doc_id are each returned and do not drop each other's lines. Other columns of
    `docs` are ignored. Keys are compared by 128 hash bits. Bytes
    that are not valid UTF-8 are kept as they are.

    Hashes are dealt by equal ranges of their (uniform) value, so no sampling
    pass is needed to find the ranges, and sorted within a slice by document
    and place; a key's rows stream by with one document number as state.
    """
    size = text_bytes(docs)
    slices, parts = max(64, math.ceil(size / (4 << 20))), max(48, math.ceil(size / (4 << 20)))
    answers = dropped(line_rows(docs, least, slices), max(8, slices // 4), parts)

    def make(ids, texts, gone):
        n_lines, n_dropped, bitmaps, kept = [], [], [], []
        for value, out in zip(texts, gone):
            lines = (value or b"").split(b"\n")
            keep = np.ones(len(lines), bool)
            keep[out[out < len(lines)]] = False
            n_lines.append(len(lines))
            n_dropped.append(int(len(lines) - keep.sum()))
            bitmaps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            if text:
                kept.append(b"\n".join([x for x, k in zip(lines, keep.tolist()) if k]) if len(out) else value or b"")
        columns = {"doc_id": pa.array(ids, pa.int64()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "keep": pa.array(bitmaps, pa.binary())}
        return columns | ({"kept": as_text(kept)} if text else {})

    return owner.with_places(docs, answers, parts, make, "doc_id long, n_lines long, n_dropped long, keep binary" + ", kept string" * text, extra)
