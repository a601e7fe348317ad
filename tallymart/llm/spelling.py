"""Operator 12, spelling variants: numbered nodes of a trie of words and one of reversed words, joined as pairs across a skipped or inserted place."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, ranges, strings

LETTERS = re.compile("[a-zÀ-ÿ]+")
#: Words that a task counts before it hands them on; cells of node numbers in a record batch.
HELD, CELLS = 200_000, 1 << 20
SHIFT = 40

NODES_SQL = "word string, n long, part long, first boolean, last boolean, nodes array<long>"
PAIRS_SQL = "a long, b long, kind byte, no long, n long"


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, slip: int | None = None) -> DataFrame:
    """(word, n): the maximal runs of A-Z, a-z and U+00C0 to U+00FF of all texts, A-Z lower-cased, with their occurrences.

    With `slip`, a run r of document d loses a letter wherever h = crc32("d:r") is a multiple of it: the one at h % length. Words
    under `least_length` letters or `least_count` occurrences are left out. A null text has none; a null doc_id reads as an
    empty one; repeated rows count each; bytes that are not UTF-8 end a run; other columns are ignored. Tasks count ahead of the shuffle, so a frequent word sends a row per task and 200,000 words.
    """

    def run(batches):
        held: Counter[str] = Counter()

        def handed():
            rows = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text"))):
                start = zlib.crc32(b":" if i is None else f"{i}:".encode())
                for word, n in Counter(LETTERS.findall((text or b"").lower().decode("utf-8", "replace"))).items():
                    if len(word) < least_length:
                        continue
                    if slip and not (h := zlib.crc32(word.encode(), start)) % slip:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield handed()
        yield handed()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def common(a: str, b: str) -> int:
    """Letters that both begin with."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            return n
        n += 1
    return n


def numbered(words: DataFrame, backward: bool) -> DataFrame:
    """(word, n, part, nodes, spine): the trie nodes of a word's prefixes (suffixes, if backward), shortest first.

    Words are sorted by ranges; a range numbers the nodes that its own words bring, in order. The path that the first
    word of a range shares with the last word of the range before has numbers there: `spine` holds them, by depth, and
    stands for the first numbers of the range. So equal numbers mean equal prefixes, over all ranges.
    """
    key = F.reverse("word") if backward else F.col("word")

    def turned(w: str) -> str:
        return w[::-1] if backward else w

    def run(batches):
        part = TaskContext.get().partitionId()
        free, before, nodes, rows, cells = part << SHIFT, None, np.zeros(0, np.int64), [], 0

        def batch_of(rows):
            words, ns, firsts, lasts, paths = zip(*rows)
            offsets = np.r_[0, np.cumsum([len(p) for p in paths])].astype(np.int32)
            arrays = [pa.array(words, pa.string()), pa.array(ns, pa.int64()), pa.array([part] * len(rows), pa.int64()), pa.array(firsts), pa.array(lasts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(paths)))]
            return pa.RecordBatch.from_arrays(arrays, names=["word", "n", "part", "first", "last", "nodes"])

        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                own = turned(word)
                kept = 0 if before is None else 1 + common(before, own)
                nodes = np.concatenate([nodes[:kept], np.arange(free, free + len(own) + 1 - kept)])
                free += len(own) + 1 - kept
                if cells >= CELLS:  # the latest row waits: it may be the last
                    yield batch_of(rows[:-1])
                    rows, cells = rows[-1:], 0
                rows.append((word, n, before is None, False, nodes))
                cells += len(nodes)
                before = own
        if rows:
            rows[-1] = (*rows[-1][:3], True, rows[-1][4])
            yield batch_of(rows)

    def spines(batches):
        before, real, spine = "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                own = turned(r["word"])
                if r["first"]:
                    spine = real[: common(before, own) + 1]
                    yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int64()), pa.array([spine.tolist()], pa.list_(pa.int64()))], names=["part", "spine"])
                if r["last"]:
                    local = np.array(r["nodes"], np.int64) - (r["part"] << SHIFT)
                    shared = local < len(spine)
                    before, real = own, local + (r["part"] << SHIFT)
                    real[shared] = spine[local[shared]]

    nodes = cut(words.repartitionByRange(key).sortWithinPartitions(key).mapInArrow(run, NODES_SQL))
    edges = nodes.where("first or last").repartition(1).sortWithinPartitions("part", F.desc("first"))  # two words of each range at most
    return nodes.join(cut(edges.mapInArrow(spines, "part long, spine array<long>")), "part").select("word", "n", "part", "nodes", "spine")


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of an Arrow list column."""
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def real_nodes(batch, side: str) -> np.ndarray:
    """Node numbers of a batch's words, those of the spine put in."""
    nodes, n = flat(batch.column(f"{side}_nodes"))
    spine, m = flat(batch.column(f"{side}_spine"))
    start = batch.column(f"{side}_part").to_numpy() << SHIFT
    local = nodes - np.repeat(start, n)
    shared = local < np.repeat(m, n)
    out = nodes.copy()
    out[shared] = spine[(np.repeat(np.cumsum(m) - m, n) + local)[shared]]
    return out


def pairs(head: DataFrame, tail: DataFrame) -> DataFrame:
    """(a, b, kind, no, n): for each word, kind 0 its cuts into prefix node a and suffix node b, kind 1 and 2 the same with one letter between skipped.

    Kind 2 skips a letter that equals the one before: skipping that one leaves the same word. `no` is the node of the whole
    word, which numbers words in code-point order. head and tail: numbered() forward and backward.
    """

    def side(table: DataFrame, name: str) -> DataFrame:
        return table.select("word", *(["n"] if name == "head" else []), *(F.col(c).alias(f"{name}_{c}") for c in ("part", "nodes", "spine")))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            head, tail = real_nodes(batch, "head"), real_nodes(batch, "tail")
            n = batch.column("n").to_numpy()
            size = pc.list_value_length(batch.column("head_nodes")).to_numpy(zero_copy_only=False).astype(np.int64)
            start, length = np.cumsum(size) - size, size - 1
            codes = np.frombuffer("".join(batch.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
            again = np.r_[False, codes[1:] == codes[:-1]]
            again[np.cumsum(length) - length] = False
            no = head[start + length]
            at = ranges(start, length)  # the prefixes that end before a letter
            skip = np.repeat(start + length, length) - 1 - (at - np.repeat(start, length))  # the suffix after that letter
            a = np.r_[head[ranges(start, size)], head[at]]
            b = np.r_[tail[np.repeat(start + length, size) - (ranges(start, size) - np.repeat(start, size))], tail[skip]]
            kind = np.r_[np.zeros(size.sum(), np.int8), 1 + again.astype(np.int8)]
            arrays = [a, b, kind, np.r_[np.repeat(no, size), np.repeat(no, length)], np.r_[np.repeat(n, size), np.repeat(n, length)]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["a", "b", "kind", "no", "n"])

    return side(head, "head").join(side(tail, "tail"), "word").mapInArrow(run, PAIRS_SQL)


def near_words(pairs: DataFrame) -> DataFrame:
    """(no, n_near, best): how many words are near each word that has any, and the near word {minus n, no} of largest n, unless that is not above the word's own n.

    Words that meet at a pair with a skipped letter differ in that letter alone, so a pair has as many as the
    alphabet has letters, and one word that is the pair itself.
    """
    w = Window.partitionBy("a", "b")
    me = F.struct((-F.col("n")).alias("m"), "no")
    skips, single, whole = F.col("kind") > 0, F.col("kind") == 1, F.col("kind") == 0
    met = pairs.select(
        "kind", "no", "n", F.count(F.when(skips, 1)).over(w).alias("n_skips"), F.min(F.when(skips, me)).over(w).alias("top"), F.count(F.when(single, 1)).over(w).alias("n_single"),
        F.min(F.when(single, me)).over(w).alias("top_single"), F.min(F.when(whole, me)).over(w).alias("whole"),
    )
    n_near = F.when(whole, F.col("n_single")).otherwise(F.col("n_skips") - 1 + F.when(single & F.col("whole").isNotNull(), 1).otherwise(0))
    rivals = F.when(whole, F.col("top_single")).otherwise(F.least(F.when(F.col("top.no") != F.col("no"), F.col("top")), F.when(single, F.col("whole"))))
    met = met.select("no", n_near.alias("n_near"), rivals.alias("rival")).where("n_near > 0")
    return met.groupBy("no").agg(F.sum("n_near").alias("n_near"), F.min("rival").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(no, root_no) from (no, form_no): follow forms to the last. Every step doubles what is skipped; n at least doubles with each form, so a dozen steps end it."""
    at, before = forms.select("no", F.col("form_no").alias("root_no")), []
    while True:
        up = at.select(F.col("no").alias("root_no"), F.col("root_no").alias("higher"))
        at = cut(at.join(up, "root_no", "left").select("no", F.coalesce("higher", "root_no").alias("root_no"), F.col("higher").isNotNull().alias("moved")))
        discard(*before)
        before = [at]
        if not at.where("moved").limit(1).count():
            return at.select("no", "root_no")


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Group words by spelling: two are near if they differ by exactly one inserted, deleted or replaced code point.

    `words` has distinct words and their counts n; null and empty words are left out, other columns ignored. Returns word, form (the near word of largest n, if
    that is at least `ratio` (over 1) times the word's n; ties go to the smallest word; else null), root (follow forms to the last; the word itself if it
    has none), n, n_near and form_n. Neighbours are exact and complete. An empty table gives no rows.

    Rows stay linear in the letters of the vocabulary: two a letter. No step gathers more than one word and its path.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    tasks = 3 * words.sparkSession.sparkContext.defaultParallelism
    words = cut(words.where("word != ''").select("word", "n").coalesce(tasks))
    head, tail = numbered(words, False), numbered(words, True)
    near = near_words(pairs(head, tail))
    named = cut(head.select("word", "n", F.element_at("nodes", -1).alias("no")).join(near, "no", "left"))
    fits = -F.col("best.m") >= ratio * F.col("n")
    forms = named.where(fits).select("no", F.col("best.no").alias("form_no"), (-F.col("best.m")).alias("form_n"))
    spelled = named.select("no", "word")
    linked = forms.join(roots(forms), "no").join(spelled.withColumnsRenamed({"no": "form_no", "word": "form"}), "form_no").join(spelled.withColumnsRenamed({"no": "root_no", "word": "root"}), "root_no")
    out = named.join(linked.select("no", "form", "root", "form_n"), "no", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
