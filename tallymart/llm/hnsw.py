"""A small navigable small-world graph over unit vectors, and range search in it (after Malkov and Yashunin 2016)."""

from __future__ import annotations

import heapq
import pickle
from itertools import chain

import numpy as np

DEGREE, BASE_DEGREE, SLACK, BUILD_BEAM = 12, 24, 12, 48


class Graph:
    """links[l]: neighbours of each node on level l. Similarity is the dot product in double precision."""

    def __init__(self, vectors: np.ndarray, links: list[dict] | None = None, entry: int = 0):
        self.vectors = np.ascontiguousarray(vectors, np.float64)
        self.links = links if links is not None else [{}]
        self.entry = entry
        self.seen = np.zeros(len(vectors), np.int64)
        self.turn = 0

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        graph = cls(vectors)
        r = np.random.default_rng(11)
        levels = np.minimum((-np.log(r.random(len(vectors))) / np.log(DEGREE)).astype(int), 6)
        for i in range(len(vectors)):
            graph.insert(i, int(levels[i]))
        return graph

    def packed(self) -> bytes:
        """The links and the entry, without the vectors."""
        levels = [(np.fromiter(near, np.int32, len(near)), np.fromiter(map(len, near.values()), np.int32, len(near)), np.fromiter(chain.from_iterable(near.values()), np.int32)) for near in self.links]
        return pickle.dumps((levels, self.entry), 5)

    @classmethod
    def unpacked(cls, vectors: np.ndarray, data: bytes) -> Graph:
        """A graph to search, from packed()."""
        levels, entry = pickle.loads(data)
        return cls(vectors, [dict(zip(nodes.tolist(), np.split(near, np.cumsum(counts)[:-1]))) for nodes, counts, near in levels], entry)

    def insert(self, i: int, level: int) -> None:
        top = len(self.links) - 1
        if i == 0:
            self.links = [{0: []} for _ in range(level + 1)]
            return
        q, at = self.vectors[i], self.entry
        for l in range(top, level, -1):
            at = self.closest(q, at, l)
        start = [at]
        for l in range(min(level, top), -1, -1):
            found = self.beam(q, start, l, BUILD_BEAM)
            start = [j for _, j in found]
            own = self.choose(q, start, DEGREE)
            self.links[l][i] = own
            most = BASE_DEGREE if l == 0 else DEGREE
            for j in own:
                near = self.links[l][j]
                near.append(i)
                if len(near) > most + SLACK:
                    order = np.argsort(-(self.vectors[near] @ self.vectors[j]), kind="stable")
                    self.links[l][j] = self.choose(self.vectors[j], [near[k] for k in order], most)
        while len(self.links) <= level:
            self.links.append({i: []})
            self.entry = i

    def choose(self, q: np.ndarray, near: list[int], most: int) -> list[int]:
        """Prefer neighbours that are closer to q than to those chosen before; fill up with the closest left."""
        if len(near) <= most:
            return list(near)
        v = self.vectors[near]
        to_q, between = v @ q, v @ v.T
        own, best = [], np.full(len(near), -2.0)
        for k in range(len(near)):
            if best[k] < to_q[k]:
                own.append(k)
                if len(own) == most:
                    break
                np.maximum(best, between[k], out=best)
        chosen = set(own)
        own += [k for k in range(len(near)) if k not in chosen][: most - len(own)]
        return [near[k] for k in own]

    def closest(self, q: np.ndarray, at: int, level: int) -> int:
        best = float(self.vectors[at] @ q)
        while len(near := self.links[level][at]):
            sims = self.vectors[near] @ q
            k = int(sims.argmax())
            if sims[k] <= best:
                break
            best, at = float(sims[k]), near[k]
        return at

    def beam(self, q: np.ndarray, start: list[int], level: int, width: int, least: float = 2.0, hits: list[int] | None = None) -> list[tuple[float, int]]:
        """Best-first search; goes on as long as nodes beat the beam's worst or reach `least`. hits: gets all nodes met with `least` or more."""
        self.turn += 1
        seen, turn, vectors, links = self.seen, self.turn, self.vectors, self.links[level]
        seen[start] = turn
        sims = (vectors[start] @ q).tolist()
        queue = [(-s, j) for s, j in zip(sims, start)]
        best = list(zip(sims, start))
        heapq.heapify(queue)
        heapq.heapify(best)
        if hits is not None:
            hits += [j for s, j in zip(sims, start) if s >= least]
        while queue:
            s, j = heapq.heappop(queue)
            if -s < best[0][0] and len(best) >= width and -s < least:
                break
            near = np.array(links[j], np.int64)
            near = near[seen[near] != turn]
            if not len(near):
                continue
            seen[near] = turn
            worst = best[0][0] if len(best) >= width else -2.0
            for s, k in zip((vectors[near] @ q).tolist(), near.tolist()):
                if s >= least and hits is not None:
                    hits.append(k)
                if s > worst or s >= least:
                    heapq.heappush(queue, (-s, k))
                    heapq.heappush(best, (s, k))
                    if len(best) > width:
                        heapq.heappop(best)
                        worst = best[0][0]
        return sorted(best, reverse=True)

    def within(self, q: np.ndarray, least: float, width: int) -> list[int]:
        """Nodes found with a similarity of `least` or more."""
        if not len(self.vectors):
            return []
        at = self.entry
        for l in range(len(self.links) - 1, 0, -1):
            at = self.closest(q, at, l)
        hits: list[int] = []
        self.beam(q, [at], 0, width, least, hits)
        return hits
