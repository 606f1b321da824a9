"""A robust-pruned directed graph over the vectors of one shard, built and searched in batches.

Points first propose each other in small random leaves: every point joins the nearest of some random pivots, and the points
of a leaf are compared. The proposals are pruned so that only edges in new directions stay (relaxed by ``alpha``), and edges
are added back and pruned alike; a point that nobody points to gets an edge from its nearest. Searches are greedy with a beam
and run side by side; what they visit is joined with the neighbours of neighbours. Where these hardly overlap, the
neighbourhood is dense in all directions, and the search is repeated with a wide beam.
"""

from __future__ import annotations

import numpy as np

FAR = np.float32(9.0)
_ZERO, _ONE, _HALF, _LOW = np.uint64(0), np.uint64(1), np.uint64(32), np.uint64(2**32 - 1)
_LAST = np.uint64(int(FAR.view(np.uint32)) << 32)  # the key of no neighbour is at least this
_NONE = np.uint64(2**64 - 1)


class Graph:
    def __init__(self, x: np.ndarray, degree: int = 16, beam: int = 16, alpha: float = 1.2, seed: int = 7, leaf: int = 256, turns: int = 3, per_leaf: int = 12, landmarks: float = 32, starts: int = 8, batch: int = 128):
        """``x``: unit vectors (n, d) in float32. Distances are 1 - cosine, ``alpha`` relaxes the pruning.

        A point is compared with the other points of ``turns`` leaves of at most ``leaf`` points, whatever n. Queries from
        outside start from the nearest of an entry level that holds one in ``landmarks`` of the points, 64 at least.
        """
        self.n, self.dim = x.shape
        self.x = np.vstack([x, np.zeros((1, self.dim), np.float32)])  # the last row stands for no neighbour
        self.degree, self.beam, self.relax, self.batch, self.starts = degree, beam, np.float32(alpha), batch, starts
        self.out = np.full((self.n + 1, degree), self.n, np.int32)
        rng = np.random.default_rng(seed)
        self.entries = rng.permutation(self.n)[: max(64, int(self.n / landmarks))].astype(np.int32)
        if self.n > 1:
            proposed = np.hstack([self._leaves(rng, leaf, per_leaf) for _ in range(turns if self.n > leaf else 1)])
            for a in range(0, self.n, batch):
                p = np.arange(a, min(self.n, a + batch), dtype=np.int32)
                proposed[a : a + batch] = self._parts(self._ranked(self._keys(self.x[p], proposed[a : a + batch]), proposed.shape[1]))[0]
            self._link(np.arange(self.n, dtype=np.int32), proposed[:, : 2 * per_leaf])
            self._mend()

    def _leaves(self, rng: np.random.Generator, leaf: int, most: int) -> np.ndarray:
        """The ``most`` nearest of every point in its leaf: (n, most) ids, n for none."""
        n = self.n
        pivots = rng.permutation(n)[: max(1, 2 * n // leaf)]
        near = (self.x[:n] @ self.x[pivots].T).argmax(axis=1)
        order = np.lexsort((rng.random(n), near))
        size = min(leaf, n)
        rows = np.full(-(-n // size) * size, n, np.int64)
        rows[:n] = order
        rows = rows.reshape(-1, size)
        most = min(most, size - 1)
        out = np.full((n + 1, most), n, np.int32)
        own = np.arange(size)
        for a in range(0, len(rows), 16):
            some = rows[a : a + 16]
            v = self.x[some]
            d = 1 - np.matmul(v, v.transpose(0, 2, 1))
            d[:, own, own] = FAR
            d[np.broadcast_to((some == n)[:, None, :], d.shape)] = FAR
            top = np.argpartition(d, most - 1, axis=2)[:, :, :most]
            ids = np.take_along_axis(np.broadcast_to(some[:, None, :], d.shape), top, 2)
            out[some.reshape(-1)] = ids.reshape(-1, most)
        out[n] = n
        return out[:n]

    def _distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        # a sum whose rounding doesn't depend on the shape: one id always gets one distance
        d = 1 - np.einsum("bij,bj->bi", self.x[ids], q)
        d[ids == self.n] = FAR
        return d

    def _start(self, q: np.ndarray) -> np.ndarray:
        """The entry points nearest to each query."""
        if len(self.entries) <= self.starts:
            return np.broadcast_to(self.entries, (len(q), len(self.entries)))
        near = q @ self.x[self.entries].T
        return self.entries[np.argpartition(-near, self.starts - 1, axis=1)[:, : self.starts]]

    def _keys(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Distances and ids as one number each, so that plain sorting ranks them and brings repeats together.

        The distance is in the upper half, the id above the lowest bit, which is free to mark a node as expanded.
        """
        d = np.maximum(self._distances(q, ids), 0)
        return d.view(np.uint32).astype(np.uint64) << _HALF | ids.astype(np.uint64) << _ONE

    def _ranked(self, keys: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` smallest keys of each row without repeats, an expanded node before the same not expanded; none is _NONE."""
        keys.sort(axis=1)
        keys[:, 1:][keys[:, 1:] >> _ONE == keys[:, :-1] >> _ONE] = _NONE
        keys[keys >= _LAST] = _NONE
        keys.sort(axis=1)
        if keys.shape[1] < most:
            return np.pad(keys, ((0, 0), (0, most - keys.shape[1])), constant_values=_NONE)
        return keys[:, :most]

    def _parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of ranked keys, n and FAR for none."""
        none = keys == _NONE
        ids = np.where(none, self.n, (keys & _LOW) >> _ONE).astype(np.int32)
        return ids, np.where(none, FAR, (keys >> _HALF).astype(np.uint32).view(np.float32))

    def search(self, q: np.ndarray, start: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes reached from ``start`` for each query, nearest first: (ids, distances)."""
        keys = self._ranked(self._keys(q, start) | _ONE, beam)
        out = keys.copy()
        live = np.arange(len(q))
        while True:
            todo = (keys & _ONE != 0) & (keys != _NONE)
            more = todo.any(axis=1)
            if not more.all():
                live, keys, todo = live[more], keys[more], todo[more]
            if not len(live):
                return self._parts(out & ~_ONE | np.where(out == _NONE, _ONE, _ZERO))
            # the best nodes not yet expanded of each live query
            slots = np.argsort(~todo, axis=1, kind="stable")[:, :expand]
            open_ = np.take_along_axis(todo, slots, 1)
            picked = np.take_along_axis(keys, slots, 1)
            nodes = np.where(open_, (picked & _LOW) >> _ONE, self.n).astype(np.int32)
            np.put_along_axis(keys, slots, np.where(open_, picked & ~_ONE, picked), 1)
            near = self._keys(q[live], self.out[nodes].reshape(len(live), -1)) | _ONE
            # a node met again ranks behind itself in the beam; one that fell out of the beam is farther than all it holds
            keys = self._ranked(np.hstack([keys, near]), beam)
            out[live] = keys

    def _prune(self, p: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Up to ``degree`` of the candidates of each point: the nearest first, then those no kept one is much nearer to."""
        cand = np.where(cand == p[:, None], self.n, cand)
        d = self._distances(self.x[p], cand)
        sort = np.argsort(d, axis=1, kind="stable")
        cand, d = np.take_along_axis(cand, sort, 1), np.take_along_axis(d, sort, 1)
        v = self.x[cand]
        between = 1 - np.matmul(v, v.transpose(0, 2, 1))
        alive = d < FAR
        alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        kept = np.full((len(p), self.degree), self.n, np.int32)
        r = np.arange(len(p))
        for k in range(self.degree):
            best = alive.argmax(axis=1)
            ok = alive[r, best]
            if not ok.any():
                break
            kept[ok, k] = cand[r, best][ok]
            alive &= self.relax * between[r, best] > d
            alive[r, best] = False
        return kept

    def _link(self, new: np.ndarray, cand: np.ndarray) -> None:
        kept = np.concatenate([self._prune(new[a : a + self.batch], cand[a : a + self.batch]) for a in range(0, len(new), self.batch)])
        self.out[new] = kept
        # edges back, in rounds of at most ``degree`` a node
        src = np.repeat(new, self.degree)
        dst = kept.reshape(-1)
        ok = dst < self.n
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        pos = np.arange(len(dst)) - np.repeat(first, count)
        for turn in range(int(count.max(initial=0) + self.degree - 1) // self.degree):
            part = (pos // self.degree) == turn
            at = nodes[count > turn * self.degree]
            index = np.searchsorted(at, dst[part])
            extra = np.full((len(at), self.degree), self.n, np.int32)
            extra[index, pos[part] - turn * self.degree] = src[part]
            for a in range(0, len(at), self.batch):
                some = at[a : a + self.batch]
                self.out[some] = self._prune(some, np.hstack([self.out[some], extra[a : a + self.batch]]))

    def _mend(self) -> None:
        """Points that no edge leads to take the last place among the edges of the nearest point that they point to."""
        used = np.zeros(self.n + 1, bool)
        used[self.out.reshape(-1)] = True
        lost = np.nonzero(~used[: self.n])[0]
        to = self.out[lost, 0]
        ok = to < self.n
        self.out[to[ok], -1] = lost[ok]

    def ask(self, q: np.ndarray, k: int, beam: int = 100) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest points of queries from outside, by beam search from the entry level: (ids, distances), n and FAR for none."""
        ids, dist = [np.zeros((0, k), np.int32)], [np.zeros((0, k), np.float32)]
        for a in range(0, len(q), self.batch):
            some = q[a : a + self.batch]
            i, d = self.search(some, self._start(some), max(beam, k), 4)
            ids.append(i[:, :k])
            dist.append(d[:, :k])
        return np.concatenate(ids), np.concatenate(dist)

    def _reverse(self, lists: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of the points that have each point in their list, those that rank it high first."""
        k = lists.shape[1]
        src, dst = np.repeat(np.arange(self.n, dtype=np.int32), k), lists[: self.n].reshape(-1)
        rank = np.tile(np.arange(k), self.n)
        order = np.lexsort((rank, dst))
        src, dst = src[order], dst[order]
        pos = np.arange(len(dst)) - np.searchsorted(dst, dst)
        out = np.full((self.n + 1, most), self.n, np.int32)
        ok = (pos < most) & (dst < self.n)
        out[dst[ok], pos[ok]] = src[ok]
        return out

    def _join(self, lists: np.ndarray, dist: np.ndarray, which: np.ndarray, m: int = 6, most: int = 8) -> np.ndarray:
        """Improve the lists of some points by those of their neighbours, in place; the share of new ones among what was met."""
        k = lists.shape[1]
        back = self._reverse(lists, most)
        via = np.hstack([lists[:, :m], back])
        old, share = lists.copy(), np.zeros(len(which), np.float32)
        for a in range(0, len(which), self.batch):
            p = which[a : a + self.batch]
            cand = np.hstack([old[p], back[p], old[via[p]].reshape(len(p), -1)])
            met = (cand < self.n).sum(axis=1)
            cand[cand == p[:, None]] = self.n
            # repeats go before distances are taken, and columns that no row needs any more
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = self.n
            cand.sort(axis=1)
            some = (cand < self.n).sum(axis=1)
            share[a : a + self.batch] = some / np.maximum(met, 1)
            cand = cand[:, : max(k, int(some.max()))]
            keys = self._ranked(self._keys(self.x[p], cand), k)
            lists[p], dist[p] = self._parts(keys)
        return share

    def nearest(self, k: int, of: np.ndarray | None = None, reach: float = 9.0, wide: int = 96, loose: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest others of the points ``of``, by default of all: (ids, distances), n and FAR for none.

        Searches start at a point's own edges. Where at least ``loose`` of what a join met were different points, and the k-th
        lies within ``reach``, the search is repeated with the ``wide`` beam.
        """
        n = self.n
        lists, dist = np.full((n + 1, k), n, np.int32), np.full((n + 1, k), FAR, np.float32)
        of = np.arange(n, dtype=np.int32) if of is None else of

        def walk(which: np.ndarray, beam: int, expand: int, known: int) -> None:
            for a in range(0, len(which), self.batch):
                p = which[a : a + self.batch]
                i, d = self.search(self.x[p], np.hstack([p[:, None], lists[p, :known], self.out[p]]), max(beam, k + 1), expand)
                d[i == p[:, None]] = FAR
                sort = np.argsort(d, axis=1, kind="stable")[:, :k]
                d = np.take_along_axis(d, sort, 1)
                lists[p], dist[p] = np.where(d < FAR, np.take_along_axis(i, sort, 1), n), d

        walk(of, self.beam, 4, 0)
        if len(of) < n:  # lists of the others are their edges
            rest = np.setdiff1d(np.arange(n), of)
            lists[rest, : min(k, self.degree)] = self.out[rest, :k]
        share = self._join(lists, dist, of)
        again = of[(share >= loose) & (dist[of, -1] <= reach)]
        walk(again, wide, 8, k)
        if len(again):
            self._join(lists, dist, again)
        return lists[of], dist[of]
