"""A hierarchical navigable small-world graph over unit vectors, in flat neighbour arrays.

Level l holds a node with probability fanout ** -l. Each level is one int32 array (nodes of the level x degree, -1 where
empty). Levels are built from the top: a level starts with an exact graph over its first nodes and takes the others in
batches; a batch is searched in the graph so far, a few expansions of all its members at a time, and linked both ways
with the usual pruning that keeps links in different directions. Upper levels of up to EXACT nodes are not built: one
product with all of their nodes finds the entry as well, so a shard of some thousand vectors has one or two levels, and
one of a million four.
"""

from __future__ import annotations

import numpy as np

EXACT = 384
WIDE = 4


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, largest first."""
    if k < sims.shape[1]:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        part = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)


def _prune(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates ids (largest sims first, -1 empty), degree links: those nearer to the node than to a link before, then the nearest of the rest."""
    rows, many = ids.shape
    vectors = x[np.maximum(ids, 0)]
    between = vectors @ vectors.transpose(0, 2, 1)
    real = ids >= 0
    kept = np.zeros((rows, many), bool)
    nearest = np.full((rows, many), -2.0, np.float32)
    for j in range(many):
        take = real[:, j] & (sims[:, j] > nearest[:, j]) & (kept.sum(1) < degree)
        kept[:, j] = take
        if take.any():
            nearest[take] = np.maximum(nearest[take], between[take, j])
    order = np.argsort(np.where(kept, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :degree]
    links = np.take_along_axis(ids, order, 1)
    if links.shape[1] < degree:
        links = np.pad(links, ((0, 0), (0, degree - links.shape[1])), constant_values=-1)
    return links


class Level:
    """One level: nodes are rows of x; links hold row numbers of x."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray, degree: int):
        self.x, self.degree = x, degree
        self.place = np.full(len(x), -1, np.int32)
        self.place[nodes] = np.arange(len(nodes), dtype=np.int32)
        self.nodes = nodes
        self.links = np.full((len(nodes), degree), -1, np.int32)

    def search(self, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities, largest first, of the ef nearest nodes found from entry (rows x entries) on; -1 where fewer."""
        rows = len(queries)
        seen = np.zeros((rows, len(self.nodes) + 1), bool)
        line = np.arange(rows)[:, None]
        entry = np.where(entry >= 0, entry, entry[:, :1])
        first = np.sort(entry, axis=1)
        again = np.zeros(first.shape, bool)
        again[:, 1:] = first[:, 1:] == first[:, :-1]
        ids = np.where(again, -1, first)
        sims = np.where(again, -2.0, np.einsum("bed,bd->be", self.x[first], queries)).astype(np.float32)
        seen[line, np.where(again, len(self.nodes), self.place[first])] = True
        if ids.shape[1] < ef:
            more = ef - ids.shape[1]
            ids = np.pad(ids, ((0, 0), (0, more)), constant_values=-1)
            sims = np.pad(sims, ((0, 0), (0, more)), constant_values=-2.0)
        best = _top(sims, ef)
        ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        done = ids < 0
        live = np.arange(rows)
        while len(live):
            i, s, d = ids[live], sims[live], done[live]
            pick = np.argsort(d, axis=1, kind="stable")[:, :WIDE]  # sims are sorted, so the first open ones are the nearest
            open_ = ~np.take_along_axis(d, pick, 1)
            going = open_.any(1)
            if not going.all():
                live, i, s, d, pick, open_ = live[going], i[going], s[going], d[going], pick[going], open_[going]
                if not len(live):
                    break
            np.put_along_axis(d, pick, True, 1)
            chosen = np.where(open_, np.take_along_axis(i, pick, 1), -1)
            near = np.where(chosen[:, :, None] >= 0, self.links[self.place[np.maximum(chosen, 0)]], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            at = np.where(near >= 0, self.place[near], len(self.nodes))
            near = np.where(seen[live[:, None], at], -1, near)
            seen[live[:, None], at] = True
            got = np.matmul(self.x[np.maximum(near, 0)], queries[live][:, :, None])[:, :, 0]
            got[near < 0] = -2.0
            alls = np.concatenate([s, got], 1)
            best = _top(alls, ef)
            ids[live] = np.take_along_axis(np.concatenate([i, near], 1), best, 1)
            sims[live] = np.take_along_axis(alls, best, 1)
            done[live] = np.take_along_axis(np.concatenate([d, near < 0], 1), best, 1)
        return ids, sims

    def link(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Links nodes to the best of their candidates, and back."""
        links = _prune(self.x, ids, sims, self.degree)
        self.links[self.place[nodes]] = links
        to, frm = links.ravel(), np.repeat(nodes, self.degree)
        real = to >= 0
        to, frm = to[real], frm[real]
        new = np.einsum("pd,pd->p", self.x[to], self.x[frm])
        order = np.lexsort((-new, to))
        to, frm = to[order], frm[order]
        heads, start, count = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(start, count)
        most = min(int(count.max()), 2 * self.degree) if len(count) else 0
        offered = np.full((len(heads), most), -1, np.int32)
        fits = rank < most
        offered[np.repeat(np.arange(len(heads)), count)[fits], rank[fits]] = frm[fits]
        for at in range(0, len(heads), 1024):
            part = heads[at : at + 1024]
            both = np.concatenate([self.links[self.place[part]], offered[at : at + 1024]], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            s = np.matmul(self.x[np.maximum(both, 0)], self.x[part][:, :, None])[:, :, 0]
            s[both < 0] = -2.0
            best = _top(s, min(both.shape[1], 2 * self.degree))
            self.links[self.place[part]] = _prune(self.x, np.take_along_axis(both, best, 1), np.take_along_axis(s, best, 1), self.degree)


class Graph:
    """The graph over x, rows of length 1 (float32)."""

    def __init__(self, x: np.ndarray, fanout: int = 12, ef: int = 48, batch: int = 512, seed: int = 7):
        self.x, self.ef = x, ef
        rng = np.random.default_rng(seed)
        height = np.floor(-np.log(np.maximum(rng.random(len(x)), 1e-12)) / np.log(fanout)).astype(int)
        order = np.lexsort((rng.random(len(x)), -height))
        self.levels: list[Level] = []
        for level in range(int(height.max(initial=0)), -1, -1):
            nodes = order[: int((height >= level).sum())].astype(np.int32)
            if len(nodes) <= EXACT and level:
                self.levels = []  # a level this small above another is no help: the next one is searched whole
                continue
            self._add(nodes, 2 * fanout if level == 0 else fanout, batch)

    def _add(self, nodes: np.ndarray, degree: int, batch: int) -> None:
        level = Level(self.x, nodes, degree)
        base = nodes[:EXACT]
        sims = self.x[base] @ self.x[base].T
        np.fill_diagonal(sims, -2.0)
        best = _top(sims, min(self.ef, len(base)))
        sims = np.take_along_axis(sims, best, 1)
        level.link(base, np.where(sims > -2.0, base[best], -1).astype(np.int32), sims)
        at, ends = len(base), len(nodes)
        while at < ends:
            new = nodes[at : at + min(batch, at)]
            entry = self._entry(self.x[new], nodes[: min(at, EXACT)])
            ids, sims = level.search(self.x[new], entry, self.ef)
            own = self.x[new] @ self.x[new].T
            np.fill_diagonal(own, -2.0)
            mine = _top(own, min(16, len(new)))
            all_ids = np.concatenate([ids, np.where(np.take_along_axis(own, mine, 1) > -2.0, new[mine], -1)], 1)
            all_sims = np.concatenate([sims, np.take_along_axis(own, mine, 1)], 1)
            best = _top(all_sims, min(self.ef, all_sims.shape[1]))
            level.link(new, np.take_along_axis(all_ids, best, 1).astype(np.int32), np.take_along_axis(all_sims, best, 1))
            at += len(new)
        self.levels.append(level)

    def _entry(self, queries: np.ndarray, base: np.ndarray, many: int = 4) -> np.ndarray:
        """Places in the level below the finished ones to start from; base: nodes to scan where no level is finished."""
        if not self.levels:
            return base[_top(queries @ self.x[base].T, min(many, len(base)))]
        top = self.levels[0].nodes[:EXACT]
        entry = top[_top(queries @ self.x[top].T, min(many, len(top)))]
        for level in self.levels:
            ids, _ = level.search(queries, entry, 2 * many)
            entry = ids[:, :many]
        return entry

    def query(self, queries: np.ndarray, k: int, ef: int | None = None, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and similarities of the k nearest of each query, largest first; -1 where there are fewer."""
        ef = max(k, ef or self.ef)
        found, near = [], []
        for at in range(0, len(queries), batch):
            q = queries[at : at + batch]
            upper, self.levels = self.levels[-1], self.levels[:-1]
            try:
                entry = self._entry(q, upper.nodes[:EXACT])
            finally:
                self.levels = [*self.levels, upper]
            ids, sims = upper.search(q, entry, ef)
            found.append(ids[:, :k])
            near.append(sims[:, :k])
        return np.concatenate(found), np.concatenate(near)
