"""A navigable small-world graph in numpy: all queries of a block walk the graph in lockstep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Vectors inserted together; within such a block all are compared with all.
BLOCK = 1_024
#: Queries that walk together.
QUERIES = 256
#: Vertices opened at each step of a walk.
EXPAND = 6


class SmallWorld:
    """Graph over unit vectors, grown block by block; what is there is never rebuilt.

    A vertex links to the nearest of those that came before it and of its block, to a few farther ones that its insertion met, which lead out
    of clusters of near-equal vectors, and keeps as many links back, the nearest first. Walks enter at a sample of the vertices, the graph's upper layer.
    """

    def __init__(self, dims: int, capacity: int, links: int = 12, beam: int = 24):
        self.links, self.beam, self.n = links, beam, 0
        self.x = np.zeros((capacity, dims), np.float32)
        self.adj = np.full((capacity, 2 * links), -1, np.int32)

    @classmethod
    def stored(cls, x: np.ndarray, adj: np.ndarray, beam: int) -> SmallWorld:
        """A graph from its vectors and links, as they were when it was written."""
        graph = cls(x.shape[1], 0, adj.shape[1] // 2, beam)
        graph.x, graph.adj, graph.n = np.ascontiguousarray(x, np.float32), adj, len(x)
        graph._enter()
        return graph

    def _enter(self) -> None:
        count = min(self.n, max(64, int(4 * self.n**0.5)))
        self.entries = np.unique(np.linspace(0, self.n - 1, count).astype(int)) if self.n else np.empty(0, int)

    def insert(self, vectors: np.ndarray, least: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Insert ``vectors``. With ``least``, for each block the pairs (new, earlier) of vertices that are so similar, those within the block included.

        The beam is tuned anew whenever the graph has doubled.
        """
        tuned = self.n
        for at in range(0, len(vectors), BLOCK):
            block = np.ascontiguousarray(vectors[at : at + BLOCK], np.float32)
            ids, pairs = np.arange(self.n, self.n + len(block)), []
            own = block @ block.T
            np.fill_diagonal(own, -2)
            if self.n:
                if least is not None and self.n >= max(2 * tuned, BLOCK):
                    self.beam, tuned = self.tuned_beam(least), self.n
                met, scores = self.search(block, self.beam)
                if least is not None:
                    q, i = self._beyond(block, met, scores, least)
                    pairs.append((ids[q], i))
            else:
                met, scores = np.empty((len(block), 0), np.int64), np.empty((len(block), 0), np.float32)
            if least is not None:
                q, i = np.nonzero(np.tril(own >= least, -1))
                pairs.append((ids[q], ids[i]))
            near = np.concatenate([met, np.broadcast_to(ids, (len(ids), len(ids)))], 1)
            sims = np.concatenate([scores, own], 1)
            self.x[ids] = block
            self.n += len(block)
            self._link(ids, near, sims)
            self._enter()
            if pairs:
                yield np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])

    def _link(self, ids: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
        m, far = self.links, 3
        take = min(near.shape[1], 3 * m)
        top = np.argpartition(-sims, take - 1, 1)[:, :take] if take < near.shape[1] else np.broadcast_to(np.arange(take), sims.shape)
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), 1, kind="stable"), 1)
        pick = np.r_[np.arange(m - far), np.linspace(m - far, 3 * m - 1, far).astype(int)]
        top = top[:, pick[pick < take]]
        to, score = np.take_along_axis(near, top, 1), np.take_along_axis(sims, top, 1)
        to = np.where(score > -2, to, -1)
        self.adj[ids[:, None], np.arange(to.shape[1])] = to
        # links back, the nearest first
        frm, to, score = np.repeat(ids, to.shape[1]), to.ravel(), score.ravel()
        keep = to >= 0
        frm, to, score = frm[keep], to[keep], score[keep]
        touched = np.unique(to)
        old = self.adj[touched, m:]
        rows, cols = np.nonzero(old >= 0)
        back, held = old[rows, cols], touched[rows]
        to, frm = np.r_[to, held], np.r_[frm, back]
        score = np.r_[score, np.einsum("ij,ij->i", self.x[held], self.x[back])]
        order = np.lexsort((frm, -score, to))
        to, frm = to[order], frm[order]
        start = np.r_[True, to[1:] != to[:-1]] if len(to) else np.empty(0, bool)
        place = np.arange(len(to)) - np.maximum.accumulate(np.where(start, np.arange(len(to)), 0)) if len(to) else np.empty(0, int)
        fits = place < m
        self.adj[touched, m:] = -1
        self.adj[to[fits], m + place[fits]] = frm[fits]

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``beam`` nearest that the walk finds, in no order; -1 and -2 where there are fewer."""
        ids, scores = [], []
        for at in range(0, len(queries), QUERIES):
            i, s = self._walk(np.ascontiguousarray(queries[at : at + QUERIES], np.float32), beam)
            ids.append(i)
            scores.append(s)
        return (np.concatenate(ids), np.concatenate(scores)) if ids else (np.empty((0, beam), np.int64), np.empty((0, beam), np.float32))

    def _walk(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows = self.n, np.arange(len(q))
        ids, scores = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -2, np.float32)
        seen = np.zeros((len(q), n), bool)
        first = q @ self.x[self.entries].T
        take = min(beam, len(self.entries))
        top = np.argpartition(-first, take - 1, 1)[:, :take] if take < len(self.entries) else np.broadcast_to(np.arange(take), (len(q), take))
        ids[:, :take], scores[:, :take] = self.entries[top], np.take_along_axis(first, top, 1)
        seen[:, self.entries] = True
        opened = ids < 0
        expand, active = min(EXPAND, beam), rows
        while len(active):
            waiting = np.where(opened[active], -3, scores[active])
            pick = np.argpartition(-waiting, expand - 1, 1)[:, :expand]
            good = np.take_along_axis(waiting, pick, 1) > -2
            live = good.any(axis=1)
            active, pick, good = active[live], pick[live], good[live]
            if not len(active):
                break
            chosen = ids[active[:, None], pick]
            opened[active[:, None], pick] = True
            found = self.adj[np.where(good, chosen, 0)]
            r, e, c = np.nonzero((found >= 0) & good[:, :, None])
            v = found[r, e, c]
            fresh = ~seen[active[r], v]
            key = np.unique(r[fresh] * n + v[fresh])
            r, v = key // n, key % n
            seen[active[r], v] = True
            sims = np.einsum("ij,ij->i", q[active[r]], self.x[v])
            worst = scores[active].min(1)
            keep = sims > worst[r]
            r, v, sims = r[keep], v[keep], sims[keep]
            if not len(r):
                continue
            counts = np.bincount(r, minlength=len(active))
            place = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
            new_ids = np.full((len(active), counts.max()), -1, np.int64)
            new_scores = np.full(new_ids.shape, -2, np.float32)
            new_ids[r, place], new_scores[r, place] = v, sims
            all_ids, all_scores = np.concatenate([ids[active], new_ids], 1), np.concatenate([scores[active], new_scores], 1)
            all_open = np.concatenate([opened[active], new_ids < 0], 1)
            best = np.argpartition(-all_scores, beam - 1, 1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            scores[active] = np.take_along_axis(all_scores, best, 1)
            opened[active] = np.take_along_axis(all_open, best, 1)
        return ids, scores

    def tuned_beam(self, least: float, recall: float = 0.99, sample: int = 64) -> int:
        """The beam at which the walk finds ``recall`` of what an exhaustive search finds above ``least``, on evenly spaced vectors."""
        at = np.unique(np.linspace(0, self.n - 1, min(self.n, sample)).astype(int))
        exact = (self.x[at] @ self.x[: self.n].T >= least).sum(1)
        beam = self.beam
        while beam < self.n:
            ids, scores = self.search(self.x[at], beam)
            if ((scores >= least) & (ids >= 0)).sum() >= recall * np.minimum(exact, beam).sum():
                break
            beam *= 2
        return beam

    def within(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, id) with a similarity of ``least`` or more, as the walk finds them."""
        if not self.n or not len(queries):
            return np.empty(0, int), np.empty(0, int)
        return self._beyond(queries, *self.search(queries, self.beam), least)

    def _beyond(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The similar ones of finished walks. A beam that holds nothing else is widened until it isn't full of such: a query in a crowd walks on."""
        todo, out_q, out_i = np.arange(len(queries)), [], []
        beam = ids.shape[1]
        while len(todo):
            good = (scores >= least) & (ids >= 0)
            full = good.all(axis=1) & (beam < self.n)
            a, b = np.nonzero(good & ~full[:, None])
            out_q.append(todo[a])
            out_i.append(ids[a, b])
            todo, beam = todo[full], beam * 4
            if len(todo):
                ids, scores = self.search(queries[todo], beam)
        return (np.concatenate(out_q), np.concatenate(out_i)) if out_q else (np.empty(0, int), np.empty(0, int))
