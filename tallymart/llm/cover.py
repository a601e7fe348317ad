"""Suffix sorting in blocks with difference-cover samples (after Karkkainen 2007).

Suffixes at places p and q that tie on their first PERIOD bytes are told apart
by the ranks of the sampled suffixes at p + d and q + d, where d < PERIOD is
such that both are sampled: a difference cover has such a d for every pair of
residues. One bucket of suffixes (by leading bytes) is sorted at a time, so
beside the text only the sample's ranks, a fifth of it, are kept.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set modulo 31.
PERIOD = 31
COVER = np.array([0, 1, 3, 8, 12, 18])
BATCH = 1 << 18


def shift_table() -> np.ndarray:
    """shift[a, b]: the smallest d with a + d and b + d both in the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[COVER] = True
    at = np.arange(PERIOD)
    both = inside[(at[:, None, None] + at) % PERIOD] & inside[(at[None, :, None] + at) % PERIOD]
    assert both.any(2).all()
    return both.argmax(2)


SHIFT = shift_table()


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number; zeros beyond the end."""
    padded = np.r_[text, np.zeros(7, np.uint8)].astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out |= padded[i : i + len(text)] << np.uint64(56 - 8 * i)
    return out


def order_by_period(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of places by their first PERIOD bytes, and where a new value starts in that order."""
    keys = [words[at], words[at + 8], words[at + 16], words[at + 24] >> np.uint64(8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    return order, new


def sample_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Rank of every sampled suffix among the sampled ones, by prefix doubling; -1 elsewhere and beyond the end. A rank is the place where its group of ties starts, so only ties are sorted again."""
    at = (np.arange(0, n, PERIOD)[:, None] + COVER).ravel()
    at = at[at < n]
    ranks = np.full(n + 2 * PERIOD, -1, np.int64)
    order, new = order_by_period(words, at)
    at, place = at[order], np.arange(len(at))
    reach, starts = PERIOD, np.flatnonzero(new)
    rank = np.repeat(starts, np.diff(np.r_[starts, len(at)]))
    ranks[at] = rank
    while len(place) and reach < 2 * n:
        tied = np.ones(len(place), bool)
        tied[:-1] = rank[1:] == rank[:-1]
        tied[-1] = False
        tied[1:] |= tied[:-1]
        at, rank, place = at[tied], rank[tied], place[tied]
        key = rank * (n + 2) + ranks[np.minimum(at + reach, n)] + 1
        order = np.argsort(key)
        at, key = at[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        rank = np.repeat(place[starts], np.diff(np.r_[starts, len(at)]))
        ranks[at] = rank
        reach *= 2
    return ranks


def settle(at: np.ndarray, new: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Order the ties of a sorted bucket: quicksort of all groups of ties side by side."""
    at = at.copy()
    while not new.all():
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(at)])
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        group = np.repeat(np.arange(len(starts)), sizes)[tied]
        own = at[tied]
        pivot = at[(starts + sizes // 2)[group]]
        shift = SHIFT[own % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[own + shift] - ranks[pivot + shift])
        order = np.lexsort((side, group))
        at[tied] = own[order]
        change = np.ones(len(tied), bool)
        change[1:] = (np.diff(group[order]) != 0) | (np.diff(side[order]) != 0)
        new = new.copy()
        new[tied] = change
    return at


def suffix_buckets(text: np.ndarray, at: np.ndarray):
    """Yield the suffixes that start at `at` in sorted order, one bucket of leading bytes after another."""
    n = len(text)
    words = words_at(np.r_[text, np.zeros(64, np.uint8)])
    ranks = sample_ranks(words, n)
    lead = (words[at] >> np.uint64(40)).astype(np.int64)
    by_lead = np.argsort(lead, kind="stable")
    edges = np.r_[np.flatnonzero(np.r_[True, np.diff(lead[by_lead]) != 0]), len(at)] if len(at) else np.zeros(1, np.int64)
    low = 0
    while low < len(at):
        high = int(edges[max(np.searchsorted(edges, low + BATCH, "right") - 1, np.searchsorted(edges, low, "right"))])
        own = at[by_lead[low:high]]
        order, new = order_by_period(words, own)
        yield settle(own[order], new, ranks), words
        low = high


def equal_prefixes(text: np.ndarray, at: np.ndarray, width: int):
    """Groups of places whose next `width` bytes are equal: (places, group starts) bucket by bucket. width: 8 at least."""
    for own, words in suffix_buckets(text, at):
        new = np.zeros(len(own), bool)
        new[:1] = True
        for i in [*range(0, width - 8, 8), width - 8]:
            key = words[own + i]
            new[1:] |= key[1:] != key[:-1]
        yield own, np.flatnonzero(new)
