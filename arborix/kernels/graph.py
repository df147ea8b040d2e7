"""Graphs as edge arrays: one object at a time. Nodes are 0 .. n - 1; undirected unless said otherwise."""

from __future__ import annotations

import heapq

import numpy as np


def labels(n: int, a, b) -> np.ndarray:
    """Smallest node each node can reach, by minimum labels and pointer jumping."""
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return label


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning_forest(n: int, a, b, w, maximize: bool = False) -> np.ndarray:
    """Rows of the minimum spanning forest by weight, ties in input order."""
    w = np.asarray(w, float)
    if not np.isfinite(w).all():
        raise ValueError("edge weights must be finite")
    u, out = Union(n), []
    for k in np.argsort(-w if maximize else w, kind="stable").tolist():
        if u.join(int(a[k]), int(b[k])):
            out.append(k)
    return np.array(out, np.int64)


class Graph:
    """Adjacency lists; parallel edges keep the least weight, loops are dropped, neighbours ascend."""

    def __init__(self, n: int, a, b, w=None, directed: bool = False):
        self.n, self.weighted = n, w is not None
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        ws = np.ones(len(a)) if w is None else np.asarray(w, float)
        if len(ws) and not (ws >= 0).all():
            raise ValueError("weights must be non-negative")
        if not directed:
            a, b, ws = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([ws, ws])
        order = np.lexsort((ws, b, a))
        a, b, ws = a[order], b[order], ws[order]
        keep = a != b
        keep[1:] &= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, ends = a[keep], list(zip(b[keep].tolist(), ws[keep].tolist(), strict=True))
        cut = np.searchsorted(a, np.arange(n + 1)).tolist()
        self.near: list[list[tuple[int, float]]] = [ends[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]

    def search(self, sources, limit: float = np.inf, targets=None):
        """Distances, predecessors, owning sources and settle order of a multi-source search; limit inclusive."""
        dist, pred, owner = np.full(self.n, np.inf), np.full(self.n, -1, np.int64), np.full(self.n, -1, np.int64)
        heap, order, done = [], [], np.zeros(self.n, bool)
        for s in sources:
            if dist[s] != 0:
                dist[s], owner[s] = 0.0, s
                heap.append((0.0, int(s)))
        heapq.heapify(heap)
        left = set(targets) if targets is not None else None
        while heap:
            d, x = heapq.heappop(heap)
            if done[x] or d > dist[x]:
                continue
            done[x] = True
            order.append(x)
            if left is not None:
                left.discard(x)
                if not left:
                    break
            for y, w in self.near[x]:
                e = d + w
                if e <= limit and e < dist[y]:
                    dist[y], pred[y], owner[y] = e, x, owner[x]
                    heapq.heappush(heap, (e, y))
        dist[~done] = np.inf
        pred[~done] = owner[~done] = -1
        return dist, pred, owner, np.array(order, np.int64)

    def path(self, source: int, target: int, limit: float = np.inf) -> list[int]:
        dist, pred, *_ = self.search([source], limit, [target])
        if not np.isfinite(dist[target]):
            return []
        out = [target]
        while out[-1] != source:
            out.append(int(pred[out[-1]]))
        return out[::-1]

    def clusters(self, max_dist: float, seeds=()) -> tuple[np.ndarray, int]:
        """Greedy balls: given seeds first, then ascending; a ball reaches through what others own, and claims what is free."""
        label, k = np.full(self.n, -1, np.int64), 0
        for s in [*seeds, *range(self.n)]:
            if label[s] >= 0:
                continue
            dist = self.search([s], max_dist)[0]
            label[np.isfinite(dist) & (label < 0)] = k
            k += 1
        return label, k

    def forest(self, roots=()) -> tuple[np.ndarray, np.ndarray]:
        """Parents and settle order of a shortest-path forest; a component without a root starts at its lowest node."""
        seen = np.zeros(self.n, bool)
        parent, order = np.full(self.n, -1, np.int64), []
        for start in [list(roots), *([x] for x in range(self.n))]:
            if not start or (len(start) == 1 and seen[start[0]]):
                continue
            dist, pred, _, got = self.search(start)
            got = got[~seen[got]]
            parent[got] = pred[got]
            seen[got] = True
            order.extend(got.tolist())
        return parent, np.array(order, np.int64)

    def terminal_tree(self, nodes, limit: float = np.inf):
        """Edges (position, position, weight) of the spanning tree of geodesic distances among ``nodes``, from one sweep."""
        nodes = list(nodes)
        if len(nodes) < 2:
            return []
        dist, _, owner, _ = self.search(nodes)
        where = {x: k for k, x in reversed(list(enumerate(nodes)))}
        best: dict[tuple[int, int], float] = {}
        for x in range(self.n):
            for y, w in self.near[x]:
                if owner[x] >= 0 and owner[y] >= 0 and owner[x] != owner[y]:
                    d = dist[x] + w + dist[y]
                    e = tuple(sorted((where[owner[x]], where[owner[y]])))
                    if d <= limit and d < best.get(e, np.inf):
                        best[e] = d
        pairs = sorted(best.items(), key=lambda kv: (kv[1], kv[0]))
        u = Union(len(nodes))
        return [(a, b, d) for (a, b), d in pairs if u.join(a, b)]


def bridges(n: int, a, b) -> np.ndarray:
    """Edges whose removal splits a component; parallel edges and loops never do."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (x, y) in enumerate(zip(np.asarray(a).tolist(), np.asarray(b).tolist(), strict=True)):
        if x != y:
            near[x].append((y, k))
            near[y].append((x, k))
    out, enter, low, clock = np.zeros(len(a), bool), [-1] * n, [0] * n, 0
    for s in range(n):
        if enter[s] >= 0:
            continue
        enter[s] = low[s] = clock
        clock += 1
        stack = [(s, -1, iter(near[s]))]
        while stack:
            x, via, rest = stack[-1]
            for y, k in rest:
                if k == via:
                    continue
                if enter[y] < 0:
                    enter[y] = low[y] = clock
                    clock += 1
                    stack.append((y, k, iter(near[y])))
                    break
                low[x] = min(low[x], enter[y])
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[x])
                    if low[x] > enter[p]:
                        out[via] = True
    return out


class Items:
    """Items attached to the nodes of a graph: growing regions and spreading seeds."""

    def __init__(self, graph: Graph, item_node):
        self.graph, self.node = graph, np.asarray(item_node, np.int64)

    def grow(self, seed: int, size: int, forbidden=()) -> tuple[list[int], list[float]]:
        """The ``size`` items nearest to a seed item; nodes all of whose items are forbidden are walls, empty nodes conduct."""
        taken = np.zeros(len(self.node), bool)
        taken[list(forbidden)] = True
        held = np.bincount(self.node, minlength=self.graph.n)
        wall = (held > 0) & (np.bincount(self.node[taken], minlength=self.graph.n) == held)
        at: dict[int, list[int]] = {}
        for i in np.flatnonzero(~taken).tolist():
            at.setdefault(int(self.node[i]), []).append(i)
        start = int(self.node[seed])
        if wall[start]:
            return [], []
        dist, heap, done, items, far = {start: 0.0}, [(0.0, start)], set(), [], []
        while heap and len(items) < size:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            for i in at.get(x, []):
                if len(items) < size:
                    items.append(i)
                    far.append(d)
            for y, w in self.graph.near[x]:
                if not wall[y] and d + w < dist.get(y, np.inf):
                    dist[y] = d + w
                    heapq.heappush(heap, (d + w, y))
        return items, far

    def _labels(self) -> np.ndarray:
        if not hasattr(self, "_label"):
            a = np.repeat(np.arange(self.graph.n), [len(x) for x in self.graph.near])
            self._label = labels(self.graph.n, a, [y for x in self.graph.near for y, _ in x])
        return self._label

    def _next(self, closed: np.ndarray, dist: np.ndarray) -> int | None:
        """The open item farthest in the distance field; an unreached component's lowest item (largest first) where none is reached."""
        if closed.all():
            return None
        far = dist[self.node]
        reach = ~closed & np.isfinite(far)
        if reach.any():
            return int(np.argmax(np.where(reach, far, -1)))
        label = self._labels()[self.node]
        count = np.bincount(label[~closed], minlength=self.graph.n)
        return int(np.flatnonzero(~closed & (label == int(np.argmax(count))))[0])

    def farthest_seed(self, done) -> int | None:
        """The open item farthest from all done ones."""
        closed = np.zeros(len(self.node), bool)
        closed[list(done)] = True
        return self._next(closed, self.graph.search(sorted(set(self.node[closed].tolist())))[0])

    def spread(self, k: int) -> list[int]:
        """Farthest-point sampling of up to k items. One distance field is kept: a new seed searches only where it is nearer."""
        dist, closed = np.full(self.graph.n, np.inf), np.zeros(len(self.node), bool)
        out: list[int] = []
        while len(out) < k:
            seed = self._next(closed, dist)
            if seed is None:
                break
            out.append(seed)
            closed[seed] = True
            heap = [(0.0, int(self.node[seed]))]
            dist[heap[0][1]] = 0.0
            while heap:
                d, x = heapq.heappop(heap)
                if d > dist[x]:
                    continue
                for y, w in self.graph.near[x]:
                    if d + w < dist[y]:
                        dist[y] = d + w
                        heapq.heappush(heap, (d + w, y))
        return out


__all__ = ["Graph", "Items", "Union", "bridges", "labels", "spanning_forest"]
