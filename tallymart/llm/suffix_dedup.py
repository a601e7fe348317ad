"""Operator 4, suffix-array dedup: bytes in strings that a document with a smaller id holds too.

1. Every string of `width` bytes picks one anchor among its substrings of GRAM
   bytes, by the least hash; equal strings pick alike. Neighbours that share an
   anchor form a stretch. Only (anchor, stretch) hashes are shuffled, about one
   per 14 bytes; they choose which stretches are to be compared, and decide nothing. An
   anchor seen in one stretch only can hold no repeat.
2. Stretches whose hashes are equal are copies of each other in all likelihood. They
   lie next to each other in order of document, and each is compared with the one
   before it on its bytes: at once within a block of text, else the earlier
   document sends its bytes, many stretches in one run, to the later one.
3. The distinct stretches around an anchor that documents share (the edges of
   repeats), go by anchor to the tasks that sort all
   their suffixes with difference-cover samples, bucket by bucket
   (cover.py). Neighbours in that order that agree on `width` bytes are
   repeats; all but those of the smallest document go. Around an anchor with
   very many stretches the strings are dealt by their own hash instead.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import first_owner as owner
from .common import blocks, cut, pack, ranges, strings, text_bytes, unpack
from .cover import equal_prefixes
from .hashing import BASE, SECOND, mix, prefix, spans

GRAM = 24
#: Bytes hashed at once; longer documents are cut with an overlap, which only adds stretches.
SEGMENT = 1 << 20
#: Stretches around one anchor beyond which they are dealt as single strings.
HOT = 20_000
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
#: what 0: runs that go; 1: stretches to compare around their anchor; 2: the same around a hot anchor; 3: stretches of an
#: earlier document (ids, counts, gaps) that the stretches of later documents (later, shift: how far on) are to be compared with. For 1 and 2, later is the bucket.
ANSWER = "what int, part int, ids binary, counts binary, gaps binary, later binary, shift binary"
#: What goes: what 0 as above; what 3: ids, starts and numbers of starts (plain), with the bytes of the earlier document.
GONE = "what int, part int, ids binary, counts binary, gaps binary, text binary"
ASKED_SQL = "what int, bucket int, ids binary, counts binary, gaps binary, text binary"
ASKED = pa.schema([("what", pa.int32()), ("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("gaps", pa.binary()), ("text", pa.binary())])


def code(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A run of `count` string starts from `at` on, as one number; count: at most 32."""
    return at.astype(np.int64) * 32 + count - 1


def decode(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs >> 5, (runs & 31) + 1


def stretches(data: np.ndarray, sizes: np.ndarray, width: int):
    """(text number, first start, number of starts, anchor hash, stretch hash) of texts that lie one after another."""
    w, n = width - GRAM + 1, len(data)
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = prefix(data.astype(np.uint64) + np.uint64(1), BASE)
    at = np.arange(n - GRAM + 1)
    grams = mix(spans(sums, at, at + GRAM, BASE))
    low24 = np.uint64((1 << 24) - 1)
    key = (grams & ~low24) | at.astype(np.uint64)
    # Least key of every w neighbours: least of a block's tail and of the next block's head.
    pad = -len(key) % w
    table = np.r_[key, np.full(pad, ~np.uint64(0))].reshape(-1, w)
    head = np.minimum.accumulate(table, 1).ravel()
    tail = np.ascontiguousarray(np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1]).ravel()
    starts = n - width + 1
    least = (np.minimum(tail[:starts], head[w - 1 : w - 1 + starts]) & low24).astype(np.int64)
    number = np.repeat(np.arange(len(sizes)), sizes)
    whole = number[:starts] == number[width - 1 :]
    new = np.r_[True, (least[1:] != least[:-1]) | (number[1:starts] != number[: starts - 1])]
    first = np.flatnonzero(new & whole)
    last = np.flatnonzero(np.r_[new[1:] | ~whole[1:], True] & whole)
    begin = (np.cumsum(sizes) - sizes)[number[first]]
    text = mix(spans(sums, first, last + width, BASE) + (last - first).astype(np.uint64) * np.uint64(SECOND))
    return number[first], first - begin, last - first + 1, grams[least[first]], text


def segments(ids, texts, width: int):
    """Texts joined to about SEGMENT bytes: (documents, offsets, bytes, sizes)."""
    group, size = [], 0
    for i, text in zip(ids, texts):
        for at in range(0, max(1, len(text) - width + 1), SEGMENT):
            piece = text[at : at + SEGMENT + width - 1]
            if size + len(piece) > 2 * SEGMENT and group:
                yield group
                group, size = [], 0
            group.append((i, at, piece))
            size += len(piece)
    if group:
        yield group


def all_stretches(texts, width: int):
    """(text number, first start, number of starts, anchor hash, stretch hash) of all texts, piece by piece."""
    for group in segments(range(len(texts)), texts, width):
        data = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
        number, at, count, gram, text = stretches(data, np.array([len(x[2]) for x in group]), width)
        yield np.array([x[0] for x in group], np.int64)[number], at + np.array([x[1] for x in group], np.int64)[number], count, gram, text


def copies(data: np.ndarray, place: np.ndarray, length: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which stretches equal, byte by byte, one of a smaller document; a key that different stretches share gives none."""
    order = np.lexsort((doc, key))
    starts = owner.runs(key[order])
    first = np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    gone = doc[order] > doc[order][first]
    at, equal = np.flatnonzero(np.arange(len(order)) != first), np.ones(len(order), bool)
    words = np.ndarray((max(0, len(data) - 7),), np.uint64, data, 0, (1,))  # the 8 bytes from each place on
    mine, other = order[at], order[at - 1]
    same, n, x, y = length[mine] == length[other], length[mine], place[mine], place[other]
    y = np.where(same, y, x)
    for step in range(0, int(n.max(initial=8)) - 7, 8):
        own = np.minimum(step, n - 8)
        same &= words[x + own] == words[y + own]
    same &= words[x + n - 8] == words[y + n - 8]
    equal[at] = same
    if len(starts):
        gone &= np.repeat(np.logical_and.reduceat(equal, starts), np.diff(np.r_[starts, len(order)]))
    out = np.empty(len(order), bool)
    out[order] = gone
    return out


def anchor_cells(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Cells of (anchor: 5 bytes, stretch: 6 bytes) per bucket of anchors; copies of a smaller document's stretches in the block are answered at once."""

    def run(batches):
        for block in blocks(batches, owner.BLOCK):
            texts = strings(block.column("text"))
            number, at, count, gram, text = map(np.concatenate, zip(*all_stretches(texts, width)))
            doc = block.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[number]
            base = np.cumsum([len(t) for t in texts]) - [len(t) for t in texts]
            gone = copies(np.frombuffer(b"".join(texts), np.uint8), base[number] + at, count + width - 1, text ^ gram, doc)
            keys = np.concatenate([gram.view(np.uint8).reshape(-1, 8)[:, :5], text.view(np.uint8).reshape(-1, 8)[:, :6]], 1)
            runs, ask = code(at, count), ~gone
            rows = list(owner.cells(doc[ask], runs[ask], ((gram >> np.uint64(40)) % np.uint64(buckets))[ask], keys[ask])) if ask.any() else []
            if gone.any():
                rows.append((int(doc[0] % buckets), b"", *owner.places(doc[gone], runs[gone])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), owner.CELL)] if rows else [pa.array([], t.type) for t in owner.CELL], schema=owner.CELL)

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, owner.CELL_SQL)


def answer_rows(what: int, doc: np.ndarray, at: np.ndarray, parts: int, later: np.ndarray | None = None, shift: np.ndarray | None = None, bucket: np.ndarray | None = None) -> pa.Table:
    """Rows of ANSWER by part of `doc`. With `later`: ordered so that a run of stretches copied by one document lies together. bucket: of the anchors, for stretches to compare."""
    if later is None:
        order = np.lexsort((at, doc))
    else:
        order = np.lexsort((at, mix(later.astype(np.uint64)) + shift.astype(np.uint64), doc))
    doc, at = doc[order], at[order]
    rows = []
    for p, own in owner.split(owner.parts_of(doc, parts)):
        more = (pack(later[order][own]), pack(shift[order][own])) if later is not None else (pack(bucket[order][own]) if bucket is not None else None, None)
        rows.append((what, p, *owner.places(doc[own], at[own]), *more))
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("what", "part", "ids", "counts", "gaps", "later", "shift"), kinds))})


def answers(asked: DataFrame, parts: int, buckets: int) -> DataFrame:
    """What is to be done with the stretches of each bucket of anchors: rows of ANSWER."""

    def run(table):
        docs, runs, keys, known = [], [], [], []
        for key, *packed in zip(*(table.column(n).to_pylist() for n in ("keys", "ids", "counts", "gaps"))):
            doc, at = owner.unpack_places(*packed)
            docs.append(doc)
            runs.append(at)
            known.append(np.full(len(doc), not key))
            keys.append(np.frombuffer(key, np.uint8).reshape(-1, 11) if key else np.zeros((len(doc), 11), np.uint8))
        doc, at, known, key = np.concatenate(docs), np.concatenate(runs), np.concatenate(known), np.concatenate(keys)
        tables = [answer_rows(0, doc[known], at[known], parts)]
        doc, at, key = doc[~known], at[~known], key[~known]
        wide = np.zeros((len(key), 16), np.uint8)
        wide[:, :5], wide[:, 8:14] = key[:, :5], key[:, 5:]
        gram, text = wide.view(np.uint64).T
        order = np.lexsort((doc, text, gram))
        doc, at, gram, text = doc[order], at[order], gram[order], text[order]
        if len(doc):
            new_gram = np.r_[True, gram[1:] != gram[:-1]]
            new = new_gram | np.r_[True, text[1:] != text[:-1]]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.r_[starts, len(doc)])
            first = np.repeat(doc[starts], sizes) == doc
            group = np.cumsum(new_gram) - 1
            kinds = np.bincount(group, new).astype(np.int64)[group]
            for what, own in ((1, first & (kinds > 1) & (kinds <= HOT)), (2, first & (kinds > HOT))):
                tables.append(answer_rows(what, doc[own], at[own], parts, bucket=(mix(gram[own].copy()) % np.uint64(buckets)).astype(np.int64)))
            # Each later stretch is compared with the first one of the document before it: that one is, or was compared with, the smallest.
            new_doc = new | np.r_[True, doc[1:] != doc[:-1]]
            of_doc = np.flatnonzero(new_doc)
            before = np.repeat(np.r_[0, of_doc[:-1]], np.diff(np.r_[of_doc, len(doc)]))
            own, source = np.flatnonzero(~first), before[~first]
            tables.append(answer_rows(3, doc[source], at[source], parts, doc[own], (at[own] >> 5) - (at[source] >> 5)))
        return pa.concat_tables(tables)

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def marked(table, whats) -> dict[int, np.ndarray]:
    """Runs by document of the rows of these kinds."""
    found = [owner.unpack_places(*x[1:]) for x in zip(*(table.column(n).to_pylist() for n in ("what", "ids", "counts", "gaps"))) if x[0] in whats]
    if not found:
        return {}
    doc, at = map(np.concatenate, zip(*found))
    order = np.lexsort((at, doc))
    starts = owner.runs(doc[order])
    return dict(zip(doc[order][starts].tolist(), np.split(at[order], starts[1:])))


def source_runs(table, parts: int):
    """(document, first start, starts, later document, its first start, its part) of the stretches to send, as whole runs of neighbours."""
    for what, *packed, later, shift in zip(*(table.column(n).to_pylist() for n in ("what", "ids", "counts", "gaps", "later", "shift"))):
        if what != 3:
            continue
        doc, at = owner.unpack_places(*packed)
        later, shift, (at, count) = unpack(later, np.int64), unpack(shift, np.int64), decode(at)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (later[1:] != later[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] != at[:-1] + count[:-1])
        starts = np.flatnonzero(new)
        yield from zip(*(x.tolist() for x in (doc[starts], at[starts], np.add.reduceat(count, starts), later[starts], at[starts] + shift[starts], owner.parts_of(later[starts], parts))))


def stretch_cells(by_part, answered: DataFrame, width: int, buckets: int, parts: int) -> DataFrame:
    """The bytes of the stretches to compare: what 1, by bucket of anchors (or of strings); what 3, by part of the later document."""

    def run(docs, table):
        rows, sent = [], {}
        texts = dict((i, t) for i, t in zip(docs.column("doc_id").to_pylist(), strings(docs.column("text"))) if t and i is not None)  # a repeated row once
        for doc, at, count, later, there, part in source_runs(table, parts):
            piece = texts[doc][at : at + count + width - 1]
            if len(piece) == count + width - 1:
                sent.setdefault(part, []).append((later, there, count, piece))
        for part, own in sent.items():
            rows.append((3, part, *(np.array([x[k] for x in own], np.int64).tobytes() for k in range(3)), b"".join(x[3] for x in own)))
        found = [(w, *owner.unpack_places(*x), unpack(b, np.int64)) for w, *x, b in zip(*(table.column(n).to_pylist() for n in ("what", "ids", "counts", "gaps", "later"))) if w in (1, 2)]
        if found:
            doc, runs, bucket = (np.concatenate(x) for x in list(zip(*found))[1:])
            single = np.repeat([x[0] == 2 for x in found], [len(x[1]) for x in found])
            known, which = np.unique(doc, return_inverse=True)
            own = [texts[i] for i in known.tolist()]
            sizes = np.array([len(t) for t in own])
            data, (at, count) = np.frombuffer(b"".join(own), np.uint8), decode(runs)
            inside = at + count + width - 1 <= sizes[which]
            place = (np.cumsum(sizes) - sizes)[which] + at
            for hot in (False, True):
                mine = inside & (single == hot)
                if not mine.any():
                    continue
                d, r, p, c, g = doc[mine], at[mine], place[mine], count[mine], bucket[mine]
                if hot:
                    d, r, p, c = np.repeat(d, c), ranges(r, c), ranges(p, c), np.ones(c.sum(), np.int64)
                    g = (mix(spans(prefix(data.astype(np.uint64) + np.uint64(1), SECOND), p, p + width, SECOND)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((r, d, g))
                d, r, p, c, g = d[order], r[order], p[order], c[order], g[order]
                for low, high in zip(s := owner.runs(g), np.r_[s[1:], len(g)]):
                    text = data[ranges(p[low:high], c[low:high] + width - 1)].tobytes()
                    rows.append((1, int(g[low]), *owner.places(d[low:high], code(r[low:high], c[low:high])), text))
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows), ASKED)] if rows else [pa.array([], t.type) for t in ASKED], schema=ASKED)

    return by_part.cogroup(answered.where("what > 0").groupBy("part")).applyInArrow(run, ASKED_SQL)


def compared(cells: DataFrame, width: int, parts: int) -> DataFrame:
    """Sort the suffixes of a bucket's stretches; strings that a smaller document holds go."""

    def run(table):
        docs, runs, texts = [], [], []
        for ids, counts, gaps, text in zip(*(table.column(n).to_pylist() for n in ("ids", "counts", "gaps", "text"))):
            doc, at = owner.unpack_places(ids, counts, gaps)
            docs.append(doc)
            runs.append(at)
            texts.append(text)
        doc, (at, count) = np.concatenate(docs), decode(np.concatenate(runs))
        text = np.frombuffer(b"".join(texts), np.uint8)
        base = np.cumsum(count + width - 1) - (count + width - 1)
        owner_of = np.repeat(np.arange(len(doc)), count + width - 1)
        gone = []
        for own, starts in equal_prefixes(text, ranges(base, count), width):
            d = doc[owner_of[own]]
            gone.append(own[d > np.repeat(np.minimum.reduceat(d, starts), np.diff(np.r_[starts, len(own)]))])
        gone = np.sort(np.concatenate(gone))
        which = owner_of[gone]
        rows = answer_rows(0, doc[which], code(at[which] + gone - base[which], np.ones(len(gone), np.int64)), parts)
        return rows.drop_columns(["later", "shift"]).append_column("text", pa.nulls(rows.num_rows, pa.binary()))

    return cells.groupBy("bucket").applyInArrow(run, GONE)


def same_bytes(table, texts: dict[int, bytes], width: int) -> dict[int, list[tuple[int, int]]]:
    """(start, starts) by document of the runs whose bytes an earlier document sent."""
    out: dict[int, list[tuple[int, int]]] = {}
    for what, *packed, sent in zip(*(table.column(n).to_pylist() for n in ("what", "ids", "counts", "gaps", "text"))):
        if what == 3:
            place = 0
            for doc, at, count in zip(*(np.frombuffer(x, np.int64).tolist() for x in packed)):
                n = count + width - 1
                if texts[doc][at : at + n] == sent[place : place + n]:
                    out.setdefault(doc, []).append((at, count))
                place += n
    return out


def suffix_dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """Remove each byte in a string of `width` bytes that also starts in a document with a smaller doc_id.

    Texts are UTF-8 bytes; strings never cross documents and are judged on
    the input. Returns doc_id, n_bytes, n_removed, n_spans, spans (maximal
    removed runs [start, end)) and kept (the bytes left; they may cut a
    character, so they are binary).

    Null and empty texts have no bytes. A row with a null doc_id keeps all
    and removes nothing from others. Rows that repeat a doc_id are
    each returned and do not remove each other; one whose text differs from the others' may keep more. Other columns are ignored.

    Nothing goes that was not found equal on its bytes. Should different stretches have equal hashes
    (88 bits), the later ones stay.

    width: from GRAM + 8 to GRAM + 31, so that a stretch has at most 32 starts.
    """
    if not GRAM + 8 <= width <= GRAM + 31:
        raise ValueError(f"width must be from {GRAM + 8} to {GRAM + 31}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = text_bytes(docs)
    buckets, parts = max(24, math.ceil(size / (12 << 20))), max(48, math.ceil(size / (4 << 20)))
    tasks = max(24, parts // 4)  # 16 MB of text each
    by_part = docs.withColumn("part", owner.part_of(F.col("doc_id"), parts)).repartition(tasks, "part").groupBy("part")
    answered = cut(answers(anchor_cells(docs, width, buckets).repartition(buckets, "bucket"), parts, 4 * buckets))  # read twice below, as is the next
    cells = cut(stretch_cells(by_part, answered.repartition(tasks, "part"), width, 4 * buckets, parts))
    more = compared(cells.where("what = 1").drop("what").repartition(2 * buckets, "bucket"), width, parts)
    sent = cells.where("what = 3").withColumnRenamed("bucket", "part")
    gone = answered.where("what = 0").select("what", "part", "ids", "counts", "gaps", F.lit(None).cast("binary").alias("text")).unionByName(more).unionByName(sent)

    def run(left, right):
        marks = marked(right, {0})
        whole = same_bytes(right, dict(zip(left.column("doc_id").to_pylist(), strings(left.column("text")))), width)
        rows = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept")}
        for i, text in zip(left.column("doc_id").to_pylist(), strings(left.column("text"))):
            text, found, sure = text or b"", marks.get(i) if i is not None else None, whole.get(i)
            low = high = np.zeros(0, np.int64)
            if found is not None or sure:
                at, count = decode(found if found is not None else np.zeros(0, np.int64))
                if sure:
                    at, count = np.concatenate([np.stack([at, count], 1), np.array(sure, np.int64)]).T
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, np.minimum(at, len(text)), 1)
                np.add.at(edge, np.minimum(at + count - 1 + width, len(text)), -1)
                out = np.cumsum(edge[:-1]) > 0
                step = np.diff(np.r_[0, out.astype(np.int8), 0])
                low, high = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            kept = text if not len(low) else np.frombuffer(text, np.uint8)[~out].tobytes()
            for column, value in zip(rows.values(), (i, len(text), len(text) - len(kept), len(low), [{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist())], kept)):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.table({n: pa.array(c, k) for (n, c), k in zip(rows.items(), kinds)})

    return by_part.cogroup(gone.repartition(tasks, "part").groupBy("part")).applyInArrow(run, OUT)
