"""Which places of a document hold a key that a document with a smaller id holds too.

Every task packs the keys of a few MB of text into one binary cell per hash
bucket. Inside such a block only the smallest document of a key asks; the
others are answered on the spot, so a key held by a third of all documents
sends one entry per block, not one per document. A bucket then sorts its keys
and answers with the places to drop, and the answers meet their documents
again through one shuffle by a function of the id.

Cells hold fixed-width keys (about 8 bytes a place) and delta-coded places, so
the shuffle stays near the size of the input instead of a row per place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, carried, pack, strings, unpack

BLOCK = 8 << 20
CELL = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("gaps", pa.binary())])
CELL_SQL = "bucket int, keys binary, ids binary, counts binary, gaps binary"
REPLY_SQL = "part int, ids binary, counts binary, gaps binary"


def part_of(doc_id: Column, parts: int) -> Column:
    """The part of documents that a (non-null) id belongs to; same as parts_of()."""
    doc_id = F.coalesce(doc_id, F.lit(0))
    return F.pmod(doc_id.bitwiseXOR(F.shiftright(doc_id, 11)), F.lit(parts)).cast("int")


def parts_of(doc_ids: np.ndarray, parts: int) -> np.ndarray:
    return np.mod(doc_ids ^ (doc_ids >> 11), parts)


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours start."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def places(doc: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Pack (document, place) pairs that lie together by document with rising places."""
    starts = runs(doc)
    gaps = np.diff(at, prepend=0)
    gaps[starts] = at[starts]
    return pack(doc[starts].astype(np.int64)), pack(np.diff(np.r_[starts, len(doc)]).astype(np.uint32)), pack(gaps.astype(np.uint64))


def unpack_places(ids: bytes, counts: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, counts, gaps = unpack(ids, np.int64), unpack(counts, np.uint32).astype(np.int64), unpack(gaps, np.uint64).astype(np.int64)
    total, starts = np.cumsum(gaps), np.cumsum(counts) - counts
    return np.repeat(ids, counts), total - np.repeat(total[starts] - gaps[starts], counts)


def split(group: np.ndarray):
    """(value, places) for each value of an array of small whole numbers, places in order."""
    order = np.argsort(group, kind="stable")
    starts = runs(group[order])
    for low, high in zip(starts, np.r_[starts[1:], len(order)]):
        yield int(group[order[low]]), order[low:high]


def later(keys: np.ndarray, doc: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Which entries have a key (64 bits, or 128 with `more`) that also comes with a smaller document."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys) if more is None else np.lexsort((more, keys))
    new = np.r_[True, keys[order][1:] != keys[order][:-1]]
    if more is not None:
        new[1:] |= more[order][1:] != more[order][:-1]
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], starts)
    out = np.empty(len(keys), bool)
    out[order] = doc[order] > np.repeat(least, np.diff(np.r_[starts, len(keys)]))
    return out


def cells(doc: np.ndarray, at: np.ndarray, bucket: np.ndarray, keys: np.ndarray):
    """One cell per bucket. doc, at: ordered by document and place; keys: a row of fixed width per entry."""
    for b, own in split(bucket.astype(np.uint16 if bucket.size and bucket.max() < 65536 else np.uint32)):
        yield (b, keys[own].tobytes(), *places(doc[own], at[own]))


def requests(docs: DataFrame, keys_of, buckets: int) -> DataFrame:
    """Cells of all documents with an id. keys_of(list of bytes): (text number, place, key, second hash) arrays."""

    def run(batches):
        for block in blocks(batches, BLOCK):
            ids = block.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            number, at, key, second = keys_of(strings(block.column("text")))
            doc = ids[number]
            gone = later(key, doc, second)
            rows = list(cells(doc[~gone], at[~gone], (second % np.uint64(buckets))[~gone], key[~gone]))
            if gone.any():
                rows.append((int(ids[0] % buckets), b"", *places(doc[gone], at[gone])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), CELL)] if rows else [pa.array([], t.type) for t in CELL], schema=CELL)

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, CELL_SQL)


def reply_rows(doc: np.ndarray, at: np.ndarray, parts: int, kind=None) -> pa.Table:
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    rows = [(p, *places(doc[own], at[own])) for p, own in split(parts_of(doc, parts))]
    names = ["part", "ids", "counts", "gaps"]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def replies(asked: DataFrame, buckets: int, parts: int) -> DataFrame:
    """Places to drop, packed by part of documents. The number of tasks grows with the buckets."""

    def run(table: pa.Table) -> pa.Table:
        docs, ats, keys, known = [], [], [], []
        for key, *packed in zip(*(table.column(n).to_pylist() for n in ("keys", "ids", "counts", "gaps"))):
            doc, at = unpack_places(*packed)
            docs.append(doc)
            ats.append(at)
            known.append(np.full(len(doc), not key))
            keys.append(np.frombuffer(key, np.uint64) if key else np.zeros(len(doc), np.uint64))
        doc, at, key, known = map(np.concatenate, (docs, ats, keys, known))
        ask = ~known
        gone = known
        gone[ask] = later(key[ask], doc[ask])
        return reply_rows(doc[gone], at[gone], parts)

    return asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, REPLY_SQL)


def with_places(docs: DataFrame, answers: DataFrame, parts: int, make, schema: str, extra: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Bring documents and their places together. make(doc ids, texts as bytes or None, places by number) gives columns; `extra` columns of docs follow them, but for those named like one of the columns."""
    extra = carried(extra, schema)
    nothing = [F.lit(None).cast("binary").alias(n) for n in ("ids", "counts", "gaps")]
    left = docs.select(part_of(F.col("doc_id"), parts).alias("part"), F.lit(1).alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), "text", *nothing, *(F.col(c).alias(f"extra_{i}") for i, c in enumerate(extra)))
    right = answers.select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "ids", "counts", "gaps", *(F.lit(None).cast(docs.schema[c].dataType).alias(f"extra_{i}") for i, c in enumerate(extra)))
    schema = ", ".join([schema, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)])
    empty = np.zeros(0, np.int64)

    def run(batches):
        now, found, known, marks = None, [], empty, []
        for batch in blocks(batches, block):
            part, kind = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("part", "kind"))
            starts = runs(part.astype(np.int64) * 2 + kind)
            for low, high in zip(starts, np.r_[starts[1:], len(part)]):
                piece = batch.slice(low, high - low)
                if part[low] != now:
                    now, found, known = part[low], [], None
                if not kind[low]:
                    found += [unpack_places(*x) for x in zip(*(piece.column(n).to_pylist() for n in ("ids", "counts", "gaps")))]
                    continue
                if known is None:
                    doc, at = (np.concatenate(x) if found else empty for x in (list(zip(*found)) or ([], [])))
                    order = np.lexsort((at, doc))
                    doc, at = doc[order], at[order]
                    first = runs(doc)
                    known, marks, found = doc[first], np.split(at, first[1:]) if len(first) else [], []
                ids = piece.column("doc_id").to_pylist()
                own = np.searchsorted(known, [i if i is not None else 0 for i in ids])
                gone = [marks[k] if i is not None and k < len(known) and known[k] == i else empty for i, k in zip(ids, own)]
                columns = make(ids, strings(piece.column("text")), gone)
                columns |= {c: piece.column(f"extra_{i}") for i, c in enumerate(extra)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return left.unionByName(right).repartition(max(8, parts // 4), "part").sortWithinPartitions("part", "kind").mapInArrow(run, schema)
