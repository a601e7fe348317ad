"""Operator 10, benchmark decontamination: one Aho-Corasick automaton over normalised test items."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, carried, map_texts, strings

#: Bytes of item text in one automaton (its nodes take up to about 300 bytes for each), and automata that a worker keeps.
BLOCK_OF_ITEMS, KEPT = 256 << 10, 4
RESULT = "doc_id long, n_words long, items array<string>, n_hit long, hits array<struct<start:int,end:int>>, contaminated boolean"
#: Bytes of text scanned at once.
TEXT = 8 << 20
#: A-Z to a-z; what is neither letter, digit nor part of a longer character to a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def normal_words(text: str | bytes | None) -> list[bytes]:
    text = text.encode() if isinstance(text, str) else text or b""
    return text.translate(NORMAL).split()


def windows(words: list[bytes], width: int):
    """All runs of `width` words; fewer words are one window; none gives none."""
    for a in range(max(1, len(words) - width + 1) if words else 0):
        yield b" ".join(words[a : a + width])


def item_blocks(benchmark: DataFrame):
    """(item_id, text) pairs in blocks of bounded size. One block at a time is on the driver: items come partition by partition, and a block is handed on before the next is filled."""
    block, size = [], 0
    for row in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        if size + len(row.text) > BLOCK_OF_ITEMS and block:
            yield block
            block, size = [], 0
        size += len(row.text)
        block.append((row.item_id, row.text))
    if block:
        yield block


def automaton(items: list[tuple[str, str]], width: int):
    """The windows of these items; None if they have no words."""
    import ahocorasick

    found: dict[str, set[str]] = {}
    for item, text in items:
        for key in windows(normal_words(text), width):
            found.setdefault(f" {key.decode(errors='replace')} ", set()).add(item)
    machine = ahocorasick.Automaton()
    for key, own in found.items():
        machine.add_word(key, (key.count(" ") - 1, own))
    if found:
        machine.make_automaton()
    return machine if found else None


def original_runs(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of hit words as code point offsets in the original text."""
    if not len(hit):
        return []
    letters = np.frombuffer(text.translate(NORMAL).decode(errors="replace").encode("utf-32-le"), np.uint32) != 32
    step = np.diff(np.r_[0, letters.astype(np.int8), 0])
    low, high = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    ends = np.flatnonzero(np.r_[np.diff(hit) != 1, True])
    begins = np.r_[0, ends[:-1] + 1]
    return [{"start": int(low[a]), "end": int(high[b])} for a, b in zip(hit[begins], hit[ends])]


def scan(docs: DataFrame, sent: list, width: int, extra: list[str]) -> DataFrame:
    """Pass the texts through the automaton of every broadcast block of items."""
    built: dict[int, object] = {}

    def machine(k: int):
        if k not in built:
            while len(built) >= KEPT:
                built.pop(next(iter(built)))
            built[k] = automaton(sent[k].value, width)
        return built[k]

    def run(batches):
        for block in blocks(batches, TEXT if len(sent) <= KEPT else 8 * TEXT):
            texts = strings(block.column("text"))
            counts, hits, items = [], [np.zeros(0, np.int32)] * len(texts), [set() for _ in texts]
            lines = []
            for value in texts:
                words = normal_words(value)
                counts.append(len(words))
                lines.append(f" {b' '.join(words).decode(errors='replace')} " if words else "")
            for k in range(len(sent)):
                if (own := machine(k)) is None:
                    continue
                for i, line in enumerate(lines):
                    if matches := list(own.iter(line)) if line else []:
                        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
                        stop = np.searchsorted(spaces, [e for e, _ in matches])
                        edge = np.zeros(counts[i] + 1, np.int32)
                        np.add.at(edge, stop - np.array([n for _, (n, _) in matches]), 1)
                        np.add.at(edge, stop, -1)
                        hits[i] = np.union1d(hits[i], np.flatnonzero(np.cumsum(edge[:-1]) > 0)).astype(np.int32)
                        items[i].update(*(who for _, (_, who) in matches))
            columns = {"doc_id": block.column("doc_id").cast(pa.int64()), "n_words": pa.array(counts, pa.int64()), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
            columns |= {"n_hit": pa.array(map(len, hits), pa.int64()), "hits": pa.array([original_runs(t, h) for t, h in zip(texts, hits)], SPAN), "contaminated": pa.array([len(h) > 0 for h in hits], pa.bool_())}
            yield block, pa.RecordBatch.from_pydict(columns)

    return map_texts(docs, run, RESULT, extra)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, extra: list[str] | None = None) -> DataFrame:
    """Find every window of `width` words of any benchmark item in the documents.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased; an item with fewer words is one window. Returns doc_id,
    n_words, n_hit (words inside an occurrence), items (item_ids, sorted as
    strings), hits (maximal runs of hit words as code point offsets [start,
    end) in the original text) and contaminated. `extra` columns of docs are carried along.

    Null and empty texts have no words. Items with a null item_id or text, or
    no words, find nothing; an empty benchmark finds nothing. Repeated rows
    and null doc_ids are returned like others; further columns are ignored.

    The items are broadcast in blocks of BLOCK_OF_ITEMS bytes, and the tasks build the
    automaton of each: one for a benchmark of up to that size. The text passes through
    all of them in one stage, without a shuffle; a worker keeps KEPT automata and
    builds others anew for every 8 * TEXT bytes of text.
    """
    extra = carried(extra, RESULT)
    names = [f"extra_{i}" for i in range(len(extra))]
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(block) for block in item_blocks(benchmark)]
    out = scan(docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in zip(extra, names))), sent, width, names)
    return out.select("doc_id", "n_words", "n_hit", "items", "hits", "contaminated", *(F.col(n).alias(c) for c, n in zip(extra, names)))
