"""Operator 8, token counts: greedy longest-match pieces, counted in linear time without building them."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, strings

REMEMBERED = 400_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a tokenizer file as bytes, without the mark of word ends; every single byte is one."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    letters, end = byte_letters(), model.get("end_of_word_suffix") or ""
    pieces = {p.removesuffix(end) if end else p for p in model["vocab"]}
    return sorted({bytes(letters[c] for c in p) for p in pieces if p and all(c in letters for c in p)} | {bytes([b]) for b in range(256)})


class Automaton:
    """A trie of the vocabulary with failure links and the number of pieces that each failure pops.

    At a node whose string is a piece, failing pops that piece and goes to the
    root. At another node, the pieces that longest match would cut from its
    string are counted once, here, and the link leads to what is left of it.
    So a word costs its length plus its number of pieces.
    """

    def __init__(self, pieces: list[bytes]):
        step: dict[int, int] = {}
        parent, letter, whole = [0], [0], [False]
        for piece in pieces:
            at = 0
            for c in piece:
                to = step.get(at << 8 | c)
                if to is None:
                    to = step[at << 8 | c] = len(parent)
                    parent.append(at)
                    letter.append(c)
                    whole.append(False)
                at = to
            whole[at] = True
        depth = [0] * len(parent)
        for v in range(1, len(parent)):
            depth[v] = depth[parent[v]] + 1
        fail, popped = [-1] * len(parent), [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if whole[v]:
                fail[v], popped[v] = 0, 1
                continue
            u, c = parent[v], letter[v]
            at, n = fail[u], popped[u]
            while at >= 0 and (at << 8 | c) not in step:
                n += popped[at]
                at = fail[at]
            fail[v], popped[v] = (step[at << 8 | c], n) if at >= 0 else (-1, 0)
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, word: bytes) -> int:
        step, fail, popped, at, n = self.step, self.fail, self.popped, 0, 0
        for c in word:
            while (to := step.get(at << 8 | c)) is None:
                n += popped[at]
                at = fail[at]
            at = to
        while at:
            n += popped[at]
            at = fail[at]
        return n


_automata: dict[str, Automaton] = {}


def token_counts(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """Words and greedy longest-match pieces of every whole text.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased;
    each is cut from its start into the longest pieces of the vocabulary. All
    single bytes are pieces, so every word can be cut. Returns doc_id,
    n_words, n_tokens for every row; null and empty texts have none. Null or
    repeated doc_ids and other columns do not matter.
    """

    def run(batches):
        if vocabulary_file not in _automata:
            _automata[vocabulary_file] = Automaton(vocabulary(vocabulary_file))
        count, known = _automata[vocabulary_file].count, {}
        for block in blocks(batches, 1 << 20):
            words, sizes = [], []
            for text in strings(block.column("text")):
                own = (text or b"").lower().split()
                words += own
                sizes.append(len(own))
            if len(known) > REMEMBERED:
                known.clear()
            for word in set(words).difference(known):
                known[word] = count(word)
            n = np.r_[0, np.cumsum(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))]
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(n[ends] - n[ends - sizes])], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
