"""Operator 6, best-fit packing: swap-based local search over documents cut into token pieces."""

from __future__ import annotations

import math
import unicodedata
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, ranges, strings
from .token_counts import byte_letters

LENGTH = 2048
#: Pieces packed together in one task; each such group leaves at most a bin or two underfull.
GROUP = 40_000
#: Parts of words kept with their ids per Python worker.
REMEMBERED = 1_000_000
#: Bytes of text that a worker splits at once.
BLOCK = 4 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The id after each document, 0.
END = bytes(4)
WHITE, LETTER, DIGIT, SIGN, OTHER = range(5)


class Store:
    """Runs of ids under a number each."""

    def __init__(self):
        self.starts, self.lengths, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.n = self.used = 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        n, at = self.n, self.used
        while n + len(lengths) > len(self.starts):
            self.starts, self.lengths = np.r_[self.starts, self.starts * 0], np.r_[self.lengths, self.lengths * 0]
        while at + len(values) > len(self.flat):
            self.flat = np.r_[self.flat, self.flat * 0]
        self.flat[at : at + len(values)] = values
        self.starts[n : n + len(lengths)] = at + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(lengths)] = lengths
        self.n, self.used = n + len(lengths), at + len(values)


def characters(of: range, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of characters of `size` UTF-8 bytes, by these bytes as one number; all else is OTHER."""
    kind, lower = np.full(256**size, OTHER, np.uint8), np.arange(256**size, dtype=np.uint16)
    kinds = {"L": LETTER, "N": DIGIT}
    for c in map(chr, of):
        own, low = c.encode(), c.lower().encode()
        if len(own) == len(low) == size:
            at = int.from_bytes(own, "big")
            kind[at], lower[at] = kinds.get(unicodedata.category(low.decode())[0], SIGN), int.from_bytes(low, "big")
    return kind, lower


#: Only these characters are split here: none of them composes or changes length in lower case (U+0130, U+023A, U+023E do).
KIND, LOWER = characters(range(0x21, 0x7F), 1)
KIND[list(b" \t\n\v\f\r")] = WHITE
LOWER = LOWER.astype(np.uint8)
PAIR_KIND, PAIR_LOWER = characters(range(0xA1, 0x250), 2)


def split_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut words into parts as this tokenizer file splits lower-cased text before it merges.

    These are fixed values of the file: 's, 't, 're, 've, 'm, 'll and 'd, else runs of letters, single digits, runs of
    signs. Words with other characters, or with what may be a special token, stay whole and as they are.
    `data` begins with white space and ends with two bytes of it. Returns the
    bytes of all parts one after another, and per part its length there, its place in data, and whether it is such a whole word.
    """
    raw = np.frombuffer(data, np.uint8)
    kind, low = KIND[raw], LOWER[raw]
    at = np.flatnonzero(raw >= 0x80)
    pair = raw[at].astype(np.uint16) << 8 | raw[at + 1]
    known = PAIR_KIND[pair] != OTHER
    at, pair = at[known], pair[known]
    kind[at] = kind[at + 1] = PAIR_KIND[pair]
    low[at], low[at + 1] = PAIR_LOWER[pair] >> 8, PAIR_LOWER[pair] & 255

    start = kind == DIGIT
    start[at + 1] = False
    start[0] = True
    start[1:] |= kind[1:] != kind[:-1]
    quote = np.flatnonzero(raw == ord("'"))
    quote = quote[kind[quote - 1] != SIGN]
    one, two = low[quote + 1], low[quote + 2]
    size = np.isin(one, list(b"stmd")) + 2 * (np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    start[quote + 1 + size] = True

    white, odd = kind == WHITE, kind == OTHER
    bar = np.flatnonzero(raw == ord("|"))
    odd[bar[raw[bar - 1] == ord("<")]] = True
    if odd.any():
        first, last = np.flatnonzero(white[:-1] & ~white[1:]) + 1, np.flatnonzero(~white[:-1] & white[1:]) + 1
        whole = np.logical_or.reduceat(odd, first)
        inside = ranges(first[whole], (last - first)[whole])
        start[inside], kind[inside], low[inside] = False, OTHER, raw[inside]
        start[first[whole]] = True
    place = np.flatnonzero(start)
    lengths, own = np.diff(place, append=len(raw)), kind[place]
    part = own != WHITE
    return low[~white], lengths[part], place[part], own[part] == OTHER


class WordIds:
    """Token ids of texts.

    The tokenizer never joins anything over white space, nor over the parts
    (letters, digits, signs) that it splits a word into, so ids of a text are
    those of its words' parts one after another. Each different part of a block of texts is looked up, and
    encoded once while it is remembered; words of rarer scripts go through the tokenizer whole. When too many parts
    are known, all are forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_letters().items() if b != ord(" ")}
        self.part, self.ids = {}, Store()

    def add(self, plain: list[bytes], whole: list[bytes]) -> None:
        letters = b" ".join(plain).decode("latin-1").translate(self.letters)
        coded = [[t.id for t in self.model.tokenize(p)] for p in letters.split(" ")] if plain else []
        coded += [c.ids for c in self.tokenizer.encode_batch_fast([w.decode(errors="replace") for w in whole], add_special_tokens=False)]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        self.part.update(zip(chain(plain, whole), range(self.ids.n, self.ids.n + len(coded))))
        self.ids.add(np.fromiter(chain.from_iterable(coded), np.uint32, lengths.sum()), lengths)

    def numbers(self, parts: list[bytes], odd: np.ndarray) -> np.ndarray:
        """Where the ids of these different parts are kept."""
        own = np.fromiter(map(self.part.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(own < 0)
        if len(self.part) + len(new) > REMEMBERED:
            self.part, self.ids = {}, Store()
            new = np.arange(len(parts))
        self.add([parts[i] for i in new[~odd[new]].tolist()], [parts[i] for i in new[odd[new]].tolist()])
        own[new] = [self.part[parts[i]] for i in new.tolist()]
        return own

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many of them each text has."""
        flat, sizes, place, odd = split_words(b" " + b"\n".join(texts) + b"  ")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
        codes = coded.indices.to_numpy()
        whole = np.zeros(len(coded.dictionary), bool)
        whole[codes] = odd
        own = self.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), whole)
        starts, lengths = self.ids.starts[own][codes], self.ids.lengths[own][codes]
        before = np.r_[0, np.cumsum(lengths)]
        return self.ids.flat[ranges(starts, lengths)], np.diff(before[np.searchsorted(place, ends)], prepend=0)


_coders: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Documents as token ids ended by id 0, cut into pieces of `length`."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = _coders.setdefault(tokenizer, None) or WordIds(tokenizer)
        _coders[tokenizer] = coder
        for block in blocks(batches, BLOCK):
            ids, lengths = coder.encode([text or b"" for text in strings(block.column("text"))])
            ends = np.cumsum(lengths)
            rows = [[], [], [], [], []]
            for doc, low, high in zip(block.column("doc_id").to_pylist(), (ends - lengths).tolist(), (ends + 1).tolist()):
                for n, at in enumerate(range(low, high, length)):
                    end = min(at + length, high)
                    crc = zlib.crc32(ids[at:end]) if end < high else zlib.crc32(END, zlib.crc32(ids[at : end - 1]))
                    for column, value in zip(rows, (doc, n, at - low, end - at, crc)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, list[int]]:
    """Best-fit decreasing: the bin of each piece, and the room left in each bin."""
    bins, room, free = np.zeros(len(sizes), np.int64), [], [[] for _ in range(length + 1)]
    some = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                some &= ~(1 << r)
        else:
            r, b = length, len(room)
            room.append(length)
        room[b] = r - size
        bins[i] = b
        if r > size:
            free[r - size].append(b)
            some |= 1 << (r - size)
    return bins, room


def local_search(sizes: np.ndarray, bins: np.ndarray, room: list[int], length: int, rounds: int = 400) -> np.ndarray:
    """Empty underfull bins by moves and exchanges that each increase the sum of squared fill.

    The emptiest bin gives: a piece moves to the bin that it fits best; else a
    piece is exchanged for a smaller one elsewhere, or two pieces for one, or
    one for two of another bin, whichever fills that bin most. As the giving bin is the
    emptiest and each step takes tokens from it, the sum of squares rises. It
    ends when the bins reach the lower bound, no step is left, or `rounds` bins
    have given. Of a giving bin the 12 largest pieces are tried one for one and the 8
    largest in pairs or for two neighbours; moves try all. These bound the search, not the pieces: all stay packed.
    """
    room = np.array(room, np.int64)
    least = -(-int(sizes.sum()) // length)
    alive = np.ones(len(room), bool)
    stuck: set[int] = set()
    for _ in range(rounds):
        open_bins = np.flatnonzero(alive & (room > 0))
        if alive.sum() <= least or not len(open_bins):
            break
        order = open_bins[np.argsort(-room[open_bins], kind="stable")]
        victim = next((int(b) for b in order if int(b) not in stuck), None)
        if victim is None:
            break
        moved = False
        while True:
            own = np.flatnonzero(bins == victim)
            if not len(own):
                alive[victim] = False
                stuck.clear()
                break
            own = own[np.argsort(-sizes[own], kind="stable")]
            other = np.flatnonzero((bins != victim) & (room[bins] > 0) & (room[bins] <= room[victim]))
            if not step(sizes, bins, room, alive, victim, own, other):
                if not moved:
                    stuck.add(victim)
                break
            moved = True
    return bins


def step(sizes, bins, room, alive, victim, own, other) -> bool:
    """One move or exchange that takes tokens from the victim; False if there is none."""
    targets = np.flatnonzero(alive & (room > 0) & (room <= room[victim]))
    targets = targets[targets != victim]
    for i in own:  # move
        fits = targets[room[targets] >= sizes[i]]
        if len(fits):
            give(sizes, bins, room, victim, int(fits[np.argmin(room[fits])]), [i], [])
            return True
    best = (0, None)
    for i in own[:12]:  # one for one
        gain = sizes[i] - sizes[other]
        gain = np.where((gain > 0) & (gain <= room[bins[other]]), gain, 0)
        if len(gain) and gain.max() > best[0]:
            k = int(np.argmax(gain))
            best = (int(gain[k]), ([i], [other[k]]))
    pairs = [(i, j) for a, i in enumerate(own[:8]) for j in own[a + 1 : 8]]
    for i, j in pairs:  # two for one
        gain = sizes[i] + sizes[j] - sizes[other]
        gain = np.where((gain > 0) & (gain <= room[bins[other]]), gain, 0)
        if len(gain) and gain.max() > best[0]:
            k = int(np.argmax(gain))
            best = (int(gain[k]), ([i, j], [other[k]]))
    by_bin = other[np.argsort(bins[other], kind="stable")]  # one for two neighbours in a bin
    if len(by_bin) > 1:
        same = bins[by_bin[1:]] == bins[by_bin[:-1]]
        first, second = by_bin[:-1][same], by_bin[1:][same]
        for i in own[:8]:
            gain = sizes[i] - sizes[first] - sizes[second]
            gain = np.where((gain > 0) & (gain <= room[bins[first]]), gain, 0)
            if len(gain) and gain.max() > best[0]:
                k = int(np.argmax(gain))
                best = (int(gain[k]), ([i], [first[k], second[k]]))
    if not best[0]:
        return False
    out, back = best[1]
    give(sizes, bins, room, victim, int(bins[back[0]]), out, back)
    return True


def give(sizes, bins, room, victim: int, target: int, out, back) -> None:
    change = int(sizes[out].sum() - (sizes[back].sum() if back else 0))
    bins[out] = target
    if back:
        bins[back] = victim
    room[target] -= change
    room[victim] += change


def pack_pieces(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Give every piece (written already: it is read twice) a sequence_id and an offset."""
    groups = max(1, math.ceil(pieces.count() / group))
    schema = PIECE + ", sequence_id long, offset long"

    def run(key, table):
        table = table.drop_columns(["bunch"])
        sizes = table.column("length").to_numpy().astype(np.int64)
        bins, room = best_fit(sizes, length)
        bins = local_search(sizes, bins, room, length)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        starts = np.flatnonzero(np.r_[True, np.diff(bins[order]) != 0])
        offset = before - np.repeat(before[starts], np.diff(np.r_[starts, len(order)]))
        table = table.take(pa.array(order))
        return table.append_column("sequence_id", pa.array(bins[order] + (key[0].as_py() << 32), pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    bunch = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    return pieces.withColumn("bunch", bunch).groupBy("bunch").applyInArrow(run, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Pack all documents into as few sequences of at most `length` tokens as the search finds.

    A document is its ids by the tokenizer file, then id 0. Documents longer
    than `length` are cut into pieces of `length`, the last one may be shorter;
    no other is cut. Returns doc_id, piece, start, length, ids_crc32 (of the
    ids as little-endian unsigned 32-bit numbers), sequence_id and offset;
    offsets of a sequence leave no gap.

    Null and empty texts are the single id 0. Rows that repeat a doc_id or have
    none are packed like others, each on its own. Further columns are ignored.
    Pieces are packed in random groups of about `group`, which bounds a task's memory
    and costs at most about a sequence per group.
    """
    return pack_pieces(cut(token_pieces(docs, tokenizer, length)), length, group)
