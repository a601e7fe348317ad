"""Operator 3, MinHash near-dedup: hash minima, banding, verification, components.

Copies with equal shingle sets collapse to one representative first. Within a
band's bucket only links to a centre, the least id, are tried. Members that are then still in
other components than their bucket's largest one are compared with the bucket in blocks inside
the tasks, by signatures first, then by full sets; only verified links leave them, and they
join whole components. So a bucket of many near copies costs a test per member, and no link
that changes a component is lost.

Only ids pass through the bands. A signature is one byte of each minimum, and
a band's bucket is named by its bytes, so signatures are kept once per
representative and joined where they are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, discard, strings
from .components import components
from .hashing import lower_ascii, mix, window_hashes, word_hashes, word_spans

#: 26 bands of 5 minima find a pair of similarity 0.85 but for 2 in 10 million.
BANDS, ROWS = 26, 5
#: Rows of pairs whose full sets are held at once.
PAIRS = 256
#: Members of a bucket, at most about, on either side of a block.
BLOCK = 1024
FEATURES = "doc_id long, n_shingles long, s1 long, s2 long, sig binary, packed binary"


def shingle_sets(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and how many each text has."""
    data = lower_ascii(np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8))
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    low, high = word_spans(data)
    number = np.searchsorted(ends, low, "right")
    words = word_hashes(data, low, high)
    n = max(0, len(words) - size + 1)
    whole = number[:n] == number[size - 1 :][:n]
    owner_of, hashes = number[:n][whole], window_hashes(words, size)[whole]
    counts = np.bincount(number, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.cumsum(counts) - counts
        whole_text = [window_hashes(words[first[t] : first[t] + counts[t]], int(counts[t]))[0] ^ np.uint64(counts[t]) for t in short]
        owner_of, hashes = np.r_[owner_of, short], np.r_[hashes, np.array(whole_text, np.uint64)]
    order = np.lexsort((hashes, owner_of))
    owner_of, hashes = owner_of[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (owner_of[1:] != owner_of[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(owner_of[new], minlength=len(texts))


def minima(hashes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """n universal hash minima (32 bits) of each non-empty set."""
    r = np.random.default_rng(20_240_607)
    a, b = r.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(starts), n), np.uint32)
    if not len(starts):
        return out
    for i in range(n):
        out[:, i] = np.minimum.reduceat(hashes * a[i] + b[i], starts) >> np.uint64(32)
    return out


def features(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Set size, identity of the set, one byte of each minimum, and the compressed text of documents with a set."""

    def run(batches):
        import zstandard

        tool = zstandard.ZstdCompressor(level=1)
        for block in blocks(batches, 1 << 20):
            texts = strings(block.column("text"))
            hashes, counts = shingle_sets(texts, size)
            full = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[full]
            same = np.zeros((2, len(counts)), np.uint64)
            if len(full):
                same[0, full] = np.add.reduceat(mix(hashes.copy()), starts)
                same[1, full] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
            least = minima(hashes, counts, bands * rows)
            sig, packed = [None] * len(counts), [None] * len(counts)
            for row, i in enumerate(full):
                sig[i], packed[i] = least[row].astype(np.uint8).tobytes(), tool.compress(texts[i])
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(same[0].view(np.int64)), pa.array(same[1].view(np.int64)), pa.array(sig, pa.binary()), pa.array(packed, pa.binary())],
                names=["doc_id", "n_shingles", "s1", "s2", "sig", "packed"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES)


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join whose sides both grow with the documents: shuffled and merged at every size, so that a small run foretells a large one."""
    return left.join(right.hint("merge"), on, how)


def alike(pairs: DataFrame, signatures: DataFrame, similarity: float, n: int) -> DataFrame:
    """Signature verification: pairs (a, b) whose minima agree in about `similarity` of all, five standard deviations allowed."""
    floor = floor_of(similarity, n)
    left = signatures.select(F.col("doc_id").alias("a"), F.col("sig").alias("x"))
    right = signatures.select(F.col("doc_id").alias("b"), F.col("sig").alias("y"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, n) for c in "xy")
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= floor))

    return sorted_join(sorted_join(pairs, left, "a"), right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets satisfy 100 * intersection >= percent * union. A much used a comes last, in a join that Spark splits."""
    with_b = sorted_join(pairs, texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("right")), "b")
    both = sorted_join(with_b, texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("left")), "a").select("a", "b", "left", "right")

    def run(batches):
        import zstandard

        tool = zstandard.ZstdDecompressor()
        for whole in batches:
            for first in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(first, PAIRS)
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                packed = dict(zip(a, batch.column("left").to_pylist())) | dict(zip(b, batch.column("right").to_pylist()))
                sets = dict(zip(packed, split_sets([tool.decompress(t) for t in packed.values()], size)))
                good = [similar(sets[x], sets[y], percent) for x, y in zip(a, b)]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def floor_of(similarity: float, n: int) -> float:
    """Share of n minima that a pair of this similarity reaches but for five standard deviations."""
    return similarity - 5 * (similarity * (1 - similarity) / n) ** 0.5


def in_blocks(mixed: DataFrame, run, schema: str, payload: list[str]) -> DataFrame:
    """Meet the members of each bucket (band, h; b, c and payload) that are not in its largest component with all members.

    run(others, members) gets record batches of at most about BLOCK rows each.
    """
    kinds = mixed.groupBy("band", "h", "c").agg(F.count("*").alias("n"))
    sizes = cut(kinds.groupBy("band", "h").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.ceil(F.sum("n") / BLOCK).alias("blocks"), F.ceil((F.sum("n") - F.max("n")) / BLOCK).alias("sides")))
    rows = mixed.join(sizes, ["band", "h"])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["band", "h", "side", "block"]
    others = rows.where("c != main").select("band", "h", F.pmod(F.xxhash64("b"), "sides").alias("side"), every("blocks").alias("block"), F.lit(0).alias("role"), "b", "c", *payload)
    members = rows.where("sides > 0").select("band", "h", every("sides").alias("side"), F.pmod(F.xxhash64("b"), "blocks").alias("block"), F.lit(1).alias("role"), "b", "c", *payload)

    def carry(batches):
        now, left = None, []
        for batch in batches:
            at = list(zip(*(batch.column(k).to_pylist() for k in (*keys, "role"))))
            edges = [i for i in range(len(at)) if not i or at[i] != at[i - 1]] + [len(at)]
            for low, high in zip(edges, edges[1:]):
                piece = batch.slice(low, high - low)
                if at[low][:-1] != now:
                    now, left = at[low][:-1], []
                if at[low][-1] == 0:
                    left.append(piece)
                elif left:
                    left = [pa.Table.from_batches(left).combine_chunks().to_batches()[0]]
                    yield from run(left[0], piece)

    return others.unionByName(members).repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(carry, schema)


def matrix(batch, name: str, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(-1, width)


def plausible(others, members, floor: float, rows: int):
    """Per row of `others`: the members of other components to compare, best first; not those met in an earlier band's bucket."""
    n = len(others.column("sig")[0].as_py())
    x, y = matrix(others, "sig", n, np.uint8), matrix(members, "sig", n, np.uint8)
    c, other_c = (t.column("c").to_numpy(zero_copy_only=False) for t in (others, members))
    before = others.column("band")[0].as_py() * rows
    for i in range(len(x)):
        same = y == x[i]
        agree = same.mean(1)
        agree[(other_c == c[i]) | same[:, :before].reshape(len(y), -1, rows).all(2).any(1)] = -1
        near = np.flatnonzero(agree >= floor)
        yield i, near[np.argsort(-agree[near], kind="stable")]


def with_payload(members: DataFrame, payload: DataFrame) -> DataFrame:
    """Members (band, h, b, c) with columns of their document, joined once per document, not once per band."""
    places = members.groupBy("b", "c").agg(F.collect_list(F.struct("band", "h")).alias("at"))  # at most one per band
    return places.join(payload, "b").withColumn("at", F.explode("at")).select("at.band", "at.h", *(c for c in dict.fromkeys(["b", "c", *payload.columns])))


def completed(mixed: DataFrame, sigs: DataFrame, texts: DataFrame, size: int, percent: int, rows: int, n: int) -> DataFrame:
    """Verified links between members of a bucket that are in different components, as pairs (a, b) of those components."""
    floor = floor_of(percent / 100, n)

    def flag(others, members):
        found, other_found = set(), set()
        for i, near in plausible(others, members, floor, rows):
            if len(near):
                found.add(i)
                other_found.update(near.tolist())
        for batch, own in ((others, found), (members, other_found)):
            yield batch.select(["band", "h", "b", "c"]).take(pa.array(sorted(own), pa.int64()))

    def verify(others, members):
        import zstandard

        tool = zstandard.ZstdDecompressor()
        sets = [split_sets([tool.decompress(t) for t in batch.column("packed").to_pylist()], size) for batch in (others, members)]
        comps = [batch.column("c").to_pylist() for batch in (others, members)]
        of: dict[int, int] = {}

        def find(c):
            while of.get(c, c) != c:
                c = of[c]
            return c

        out = [], []
        for i, near in plausible(others, members, floor, rows):
            own = sets[0][i]
            for first in range(0, len(near), 32):
                some = [k for k in near[first : first + 32].tolist() if find(comps[1][k]) != find(comps[0][i])]
                if not some:
                    continue
                lengths = np.array([len(sets[1][k]) for k in some])
                hashes = np.concatenate([sets[1][k] for k in some])
                at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
                both = np.add.reduceat((own[at] == hashes).astype(np.int64), np.cumsum(lengths) - lengths)
                for k, good in zip(some, 100 * both >= percent * (len(own) + lengths - both)):
                    if good and find(comps[1][k]) != find(comps[0][i]):
                        of[find(comps[0][i])] = find(comps[1][k])
                        out[0].append(comps[0][i])
                        out[1].append(comps[1][k])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    flagged = cut(in_blocks(with_payload(mixed, sigs), flag, "band int, h binary, b long, c long", ["sig"]).distinct())
    payload = sigs.join(texts.select(F.col("doc_id").alias("b"), "packed"), "b")
    return in_blocks(with_payload(flagged, payload), verify, "a long, b long", ["sig", "packed"])


def split_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    hashes, counts = shingle_sets(texts, size)
    return np.split(hashes, np.cumsum(counts)[:-1])


def with_component(nodes: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """`nodes` with their component under `name` in its place; a node in no link is its own."""
    return nodes.join(groups.withColumnRenamed("node", name), name, "left").withColumn(name, F.coalesce("component", name)).drop("component")


def linked_groups(sets: DataFrame, reps: DataFrame, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, c): the component of every representative."""
    n = bands * rows
    of_bands = F.expr(f"transform(sequence(0, {bands - 1}), i -> substring(sig, i * {rows} + 1, {rows}))")
    bucketed = reps.select(F.col("doc_id").alias("b"), F.posexplode(of_bands).alias("band", "h"))
    shared = cut(bucketed.groupBy("band", "h").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1"))
    joined = cut(sorted_join(bucketed, shared, ["band", "h"]))
    discard(shared)
    tried = cut(alike(joined.where("a != b").select("a", "b").distinct(), reps, percent / 100, n))
    texts = cut(sorted_join(sets.select("doc_id", "packed"), joined.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    groups = cut(components(cut(verified(tried, texts, size, percent))))
    out = with_component(reps.select("doc_id", F.col("doc_id").alias("c")), groups, "c")
    placed = cut(with_component(joined.where("n > 2").select("band", "h", "b", F.col("b").alias("c")), groups, "c"))
    discard(joined, tried)
    split = placed.groupBy("band", "h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("band", "h")
    mixed = cut(placed.join(cut(split), ["band", "h"], "left_semi"))
    discard(placed)
    if not mixed.limit(1).count():
        return out
    sigs = reps.select(F.col("doc_id").alias("b"), "sig")
    return with_component(out, components(completed(mixed, sigs, texts, size, percent, rows, n)), "c")


def minhash_dedup(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Group near-duplicate documents.

    A document's set: its distinct shingles of `size` words (runs of bytes
    other than ASCII white space, A-Z lower-cased); with fewer words the whole
    sequence is one shingle. Documents are linked if 100 * intersection >=
    percent * union, confirmed on the full sets (as 64-bit hashes). Returns
    doc_id, n_shingles, component_id (least doc_id reachable over links) and
    kept (doc_id = component_id).

    Null and empty texts have no shingles and are linked with nothing. A row
    with a null doc_id has a null component_id and is kept. Rows that repeat a
    doc_id count as one document and are each returned. Other columns are ignored.

    The number of bands must suit `percent`: 26 bands of 5 miss a pair of similarity s with
    probability (1 - s^5)^26, which is 2e-7 at 0.85 and 3e-5 at 0.8.
    """
    sets = cut(features(docs, size, bands, rows))
    full = sets.where("n_shingles > 0 and doc_id is not null")
    classes = cut(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id")))
    reps = cut(sorted_join(full, classes, ["s1", "s2", "doc_id"], "left_semi").select("doc_id", "sig").dropDuplicates(["doc_id"]))
    groups = linked_groups(sets, reps, size, percent, bands, rows)
    of_sets = cut(classes.join(groups, "doc_id").select("s1", "s2", "c"))
    discard(classes)
    out = sorted_join(sets.select("doc_id", "n_shingles", "s1", "s2"), of_sets, ["s1", "s2"], "left")
    of = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", of.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
