"""Rooted forests in arrays: one object of up to a few million nodes, in linear passes.

A parent id that is not a node id makes a root. Edge weights belong to the child; a root's weight is
not an edge. Distances accumulate in double precision. Ties go to the row that comes first.
"""

from __future__ import annotations

import numpy as np

from arborix.kernels.points import PointIndex


class CycleError(ValueError):
    """The parent relation runs in a circle."""


class Forest:
    def __init__(self, node_id, parent_id, weight=None):
        self.ids = np.asarray(node_id, np.int64)
        n = self.n = len(self.ids)
        sort = np.argsort(self.ids, kind="stable")
        ranked = self.ids[sort]
        parent = np.asarray(parent_id, np.int64)
        at = np.minimum(np.searchsorted(ranked, parent), max(n - 1, 0))
        self.parent = np.where(ranked[at] == parent, sort[at], -1) if n else np.zeros(0, np.int64)
        self.weight = np.ones(n) if weight is None else np.asarray(weight, np.float64)
        self.is_root = self.parent < 0
        self.n_children = np.bincount(self.parent[~self.is_root], minlength=n)[:n]
        # children in row order, as a compressed list
        kids = np.flatnonzero(~self.is_root)
        self.child = kids[np.argsort(self.parent[kids], kind="stable")]
        self.child_at = np.concatenate([[0], np.cumsum(self.n_children)])
        self._depth = self._levels = self._pre = None

    # -- order ------------------------------------------------------------------------------------
    @property
    def depth(self) -> np.ndarray:
        """Edges to the root, by pointer doubling; a cycle never arrives."""
        if self._depth is None:
            hop, d = self.parent.copy(), (~self.is_root).astype(np.int64)
            for _ in range(max(1, self.n).bit_length() + 1):
                live = np.flatnonzero(hop >= 0)
                if not len(live):
                    break
                d[live] += d[hop[live]]
                hop[live] = hop[hop[live]]
            if (hop >= 0).any():
                raise CycleError("parent ids form a cycle")
            self._depth = d
        return self._depth

    def has_cycles(self) -> bool:
        try:
            self.depth  # noqa: B018
        except CycleError:
            return True
        return False

    @property
    def order(self) -> np.ndarray:
        """Rows with parents before children."""
        return np.argsort(self.depth, kind="stable")

    def index(self, ids) -> np.ndarray:
        sort = np.argsort(self.ids, kind="stable")
        ranked, ids = self.ids[sort], np.asarray(ids, np.int64)
        at = np.minimum(np.searchsorted(ranked, ids), max(self.n - 1, 0))
        return np.where(ranked[at] == ids, sort[at], -1) if self.n else np.full(len(ids), -1)

    def children(self, i: int) -> list[int]:
        return self.child[self.child_at[i] : self.child_at[i + 1]].tolist()

    def _edge(self) -> np.ndarray:
        return np.where(self.is_root, 0.0, self.weight)

    # -- aggregates along the tree ------------------------------------------------------------------
    @property
    def levels(self) -> list[np.ndarray]:
        """Rows of depth 1, of depth 2 and so on, each in row order."""
        if self._levels is None:
            order, depth = self.order, self.depth
            cut = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
            self._levels = [order[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return self._levels

    def down(self, start: np.ndarray, step) -> np.ndarray:
        """value[child] = step(value[parent], child), level by level from the roots."""
        out = start.copy()
        for rows in self.levels:
            out[rows] = step(out[self.parent[rows]], rows)
        return out

    def subtree_sum(self, value: np.ndarray) -> np.ndarray:
        """Sum over the subtree, own value included, by an Euler tour."""
        pre = self.preorder()
        place = np.empty(self.n, np.int64)
        place[pre] = np.arange(self.n)
        total = np.concatenate([[0], np.cumsum(value[pre])])
        return total[place + self._sizes()] - total[place]

    def _sizes(self) -> np.ndarray:
        size = np.ones(self.n, np.int64)
        depth = self.depth
        order = np.argsort(-depth, kind="stable")
        cut = np.searchsorted(-depth[order], -np.arange(int(depth.max(initial=0)), -1, -1), "right")
        a = 0
        for b in cut.tolist():
            rows = order[a:b]
            rows = rows[self.parent[rows] >= 0]
            np.add.at(size, self.parent[rows], size[rows])
            a = b
        return size

    def preorder(self) -> np.ndarray:
        """Depth-first, children in row order; roots in row order."""
        size = self._sizes()
        place = np.zeros(self.n, np.int64)
        roots = np.flatnonzero(self.is_root)
        place[roots] = np.cumsum(size[roots]) - size[roots]
        # a child starts after its parent and its elder siblings' subtrees
        before = np.cumsum(size[self.child]) - size[self.child]
        offset = np.zeros(self.n, np.int64)
        first = self.child_at[:-1]
        base = np.zeros(self.n, np.int64)
        has = self.n_children > 0
        base[has] = before[first[has]]
        offset[self.child] = before - base[self.parent[self.child]] + 1
        place = self.down(place, lambda up, rows: up + offset[rows])
        out = np.empty(self.n, np.int64)
        out[place] = np.arange(self.n)
        return out

    def root(self) -> np.ndarray:
        return self.down(np.arange(self.n), lambda up, _: up)

    def root_distance(self, weighted: bool = True) -> np.ndarray:
        w = self._edge() if weighted else np.where(self.is_root, 0.0, 1.0)
        return self.down(np.zeros(self.n), lambda up, rows: up + w[rows])

    def height(self) -> np.ndarray:
        """Distance to the farthest leaf below."""
        far, w = np.zeros(self.n), self._edge()
        for rows in self.levels[::-1]:
            np.maximum.at(far, self.parent[rows], far[rows] + w[rows])
        return far

    def kinds(self) -> np.ndarray:
        """0 root, 1 leaf, 2 branch, 3 slab."""
        k = np.where(self.n_children == 0, 1, np.where(self.n_children > 1, 2, 3))
        return np.where(self.is_root, 0, k)

    def path(self, i: int) -> list[int]:
        out = []
        while i >= 0:
            out.append(i)
            i = int(self.parent[i])
        return out

    def descendants(self, i: int) -> np.ndarray:
        if self._pre is None:
            pre = self.preorder()
            place = np.empty(self.n, np.int64)
            place[pre] = np.arange(self.n)
            self._pre = pre, place, self._sizes()
        pre, place, size = self._pre
        return pre[place[i] : place[i] + size[i]]

    def descendant_counts(self, target=None) -> np.ndarray:
        hit = np.ones(self.n, np.int64) if target is None else np.asarray(target, np.int64)
        return self.subtree_sum(hit) - hit

    def betweenness(self, directed: bool = True) -> np.ndarray:
        size = self._sizes()
        if directed:
            return (size - 1) * self.depth
        whole = self.down(size, lambda up, _: up)
        kids = np.zeros(self.n, np.int64)
        squares = np.zeros(self.n, np.int64)
        np.add.at(kids, self.parent[self.child], size[self.child])
        np.add.at(squares, self.parent[self.child], size[self.child] ** 2)
        rest = whole - 1 - kids
        return ((kids + rest) ** 2 - squares - rest**2) // 2

    # -- distances -----------------------------------------------------------------------------------
    def distances(self, sources: np.ndarray, targets: np.ndarray, directed: bool = False, weighted: bool = True) -> np.ndarray:
        """(sources, targets) block; -1 where unreachable."""
        w = self._edge() if weighted else np.where(self.is_root, 0.0, 1.0)
        sources, targets = np.asarray(sources, np.int64), np.asarray(targets, np.int64)
        out = np.full((len(sources), len(targets)), -1.0)
        for k in range(0, len(sources), 64):
            some = sources[k : k + 64]
            # distances up from each source; from there they run down every other branch
            up = np.full((self.n, len(some)), np.inf)
            at, d = some.copy(), np.zeros(len(some))
            live = np.arange(len(some))
            while len(live):
                up[at[live], live] = d[live]
                d[live] += w[at[live]]
                at[live] = self.parent[at[live]]
                live = live[at[live] >= 0]
            if not directed:
                up = self.down(up, lambda above, rows, up=up: np.where(np.isfinite(up[rows]), up[rows], above + w[rows][:, None]))
            got = up[targets].T
            out[k : k + 64] = np.where(np.isfinite(got), got, -1.0)
        return out

    def pair_distances(self, a: np.ndarray, b: np.ndarray, directed: bool = False, weighted: bool = True) -> np.ndarray:
        """Distance of each pair of rows, by lowest common ancestors (binary lifting); -1 where unreachable."""
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        deep, depth, root = self.root_distance(weighted), self.depth, self.root()
        jumps = [np.where(self.is_root, np.arange(self.n), self.parent)]
        while (1 << len(jumps)) <= int(depth.max(initial=0)):
            jumps.append(jumps[-1][jumps[-1]])
        x, y = np.where(depth[a] >= depth[b], a, b), np.where(depth[a] >= depth[b], b, a)
        gap = depth[x] - depth[y]
        for k, jump in enumerate(jumps):
            x = np.where(gap >> k & 1, jump[x], x)
        for jump in jumps[::-1]:
            apart = jump[x] != jump[y]
            x, y = np.where(apart, jump[x], x), np.where(apart, jump[y], y)
        low = np.where(x == y, x, jumps[0][x])
        ok = root[a] == root[b]
        if directed:
            ok &= low == b
        return np.where(ok, deep[a] + deep[b] - 2 * deep[low], -1.0)

    def labels(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """What pairs among ``rows`` (unique) need to know, in depth-first order: the rows, places, ends of subtrees, number of the lowest common ancestor with the one before (-1: none), and the rows of these ancestors.

        Ancestors are numbered from the roots on, so the least number between two rows is that of their own lowest common ancestor.
        """
        pre, size = self.preorder(), self._sizes()
        place, rank = np.empty(self.n, np.int64), np.empty(self.n, np.int64)
        place[pre], rank[self.order] = np.arange(self.n), np.arange(self.n)
        rows = rows[np.argsort(place[rows])]
        # a node's lowest common ancestor with its predecessor is its parent
        gap = np.where(self.parent[pre] < 0, -1, rank[self.parent[pre]])
        low = np.full(len(rows), -1, np.int64)
        if len(rows) > 1:
            cut = place[rows[:-1]] + 1
            low[1:] = np.minimum.reduceat(gap[: place[rows[-1]] + 1], cut)
        used, number = np.unique(low[low >= 0], return_inverse=True)
        low[low >= 0] = number
        return rows, place[rows], place[rows] + size[rows], low, self.order[used]

    def extreme(self, sources: np.ndarray, targets: np.ndarray, far: bool, directed: bool, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
        """Nearest (or farthest) target other than the source itself, ties to the least id; (-1, -1) if none.

        Two passes over the levels: the best target below each node, then the best one above or beside it. A node's own
        entry is kept apart, and a parent knows its best two children, so nobody is its own answer.
        """
        n, none, sign = self.n, np.iinfo(np.int64).max, -1.0 if far else 1.0
        w = sign * (self._edge() if weighted else np.where(self.is_root, 0.0, 1.0))
        hit = np.zeros(n, bool)
        hit[np.asarray(targets, np.int64)] = True
        # entries are (signed distance, id); no target is (inf, none)
        own_d, own_i = np.where(hit, 0.0, np.inf), np.where(hit, self.ids, none)

        def best(d1, i1, d2, i2):
            left = (d1 < d2) | (d1 == d2) & (i1 <= i2)
            return np.where(left, d1, d2), np.where(left, i1, i2)

        # the best two offers of children, from different ones, and the child of the first
        d1, d2 = np.full(n, np.inf), np.full(n, np.inf)
        i1, i2, who = np.full(n, none), np.full(n, none), np.full(n, -1)
        if not directed:
            for rows in self.levels[::-1]:
                d, i = best(own_d[rows], own_i[rows], d1[rows], i1[rows])
                d, up = d + w[rows], self.parent[rows]
                order = np.lexsort((i, d, up))
                up, d, i, child = up[order], d[order], i[order], rows[order]
                first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
                d1[up[first]], i1[up[first]], who[up[first]] = d[first], i[first], child[first]
                second = first + 1
                second = second[(second < len(up))]
                second = second[up[second] == up[second - 1]]
                d2[up[second]], i2[up[second]] = d[second], i[second]
        # over the parent: its own entry, what lies above it, and its other children
        top_d, top_i = np.full(n, np.inf), np.full(n, none)
        for rows in self.levels:
            up = self.parent[rows]
            d, i = best(own_d[up], own_i[up], top_d[up], top_i[up])
            mine = who[up] == rows
            d, i = best(d, i, np.where(mine, d2[up], d1[up]), np.where(mine, i2[up], i1[up]))
            top_d[rows], top_i[rows] = d + w[rows], i
        d, i = best(d1, i1, top_d, top_i)
        there = i != none
        d, i = np.where(there, sign * d, -1.0), np.where(there, i, -1)
        sources = np.asarray(sources, np.int64)
        return np.where(sources >= 0, d[sources], -1.0) + 0.0, np.where(sources >= 0, i[sources], -1)

    # -- segments -----------------------------------------------------------------------------------
    def long_segments(self, weighted: bool = True) -> list[tuple[list[int], float]]:
        """Longest-first peel from the leaves; each ends at the first node already taken, or at a root."""
        deep = self.root_distance(weighted)
        leaves = np.flatnonzero(self.n_children == 0)
        leaves = leaves[np.argsort(-deep[leaves], kind="stable")]
        seen = np.zeros(self.n, bool)
        out = []
        for leaf in leaves.tolist():
            seg, i = [leaf], leaf
            while not seen[i]:
                seen[i] = True
                i = int(self.parent[i])
                if i < 0:
                    break
                seg.append(i)
            out.append((seg, float(deep[leaf] - deep[seg[-1]])))
        return [out[k] for k in np.argsort([-x[1] for x in out], kind="stable").tolist()]

    def linear_segments(self) -> list[list[int]]:
        """Chains between leaves, branch points and roots, both ends included, in order of the starting row."""
        stop = ((self.n_children != 1) | self.is_root).tolist()
        parent, out = self.parent.tolist(), []
        for s in np.flatnonzero((self.n_children != 1) & ~self.is_root).tolist():
            seg, i = [s], parent[s]
            while not stop[i]:
                seg.append(i)
                i = parent[i]
            seg.append(i)
            out.append(seg)
        return out

    def linear_rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``linear_segments`` one after the other, and the length of each."""
        stop = self.topology()
        hop, far = np.where(stop, np.arange(self.n), self.parent), (~stop).astype(np.int64)
        for _ in range(self.n.bit_length()):
            far += far[hop]
            hop = hop[hop]
        start = np.flatnonzero((self.n_children != 1) & ~self.is_root)
        count = far[self.parent[start]] + 2
        return climb(np.where(self.is_root, np.arange(self.n), self.parent), start, count), count

    def strahler(self, greedy: bool = False, ignore=None, min_twig_size: int | None = None) -> np.ndarray:
        leaf = self.n_children == 0
        skip_leaf = np.zeros(self.n, bool)
        if ignore is not None:
            skip_leaf |= leaf & np.asarray(ignore, bool)
        twig: dict[int, list[int]] = {}
        for i in np.flatnonzero(leaf).tolist():
            walk = [i]
            while self.n_children[walk[-1]] <= 1 and self.parent[walk[-1]] >= 0:
                walk.append(int(self.parent[walk[-1]]))
            ends_at_branch = self.n_children[walk[-1]] > 1
            if min_twig_size and len(walk) < min_twig_size and ends_at_branch:
                skip_leaf[i] = True
            twig[i] = walk
        live = np.ones(self.n, bool)
        for i in np.flatnonzero(skip_leaf).tolist():
            for x in twig[i]:
                if self.n_children[x] > 1:
                    break
                live[x] = False
        # a node all of whose children are ignored counts as a leaf of what is left
        out = np.zeros(self.n, np.int64)
        best, ties, total, kids = (np.zeros(self.n, np.int64) for _ in range(4))
        for i in self.order[::-1].tolist():
            if not live[i]:
                continue
            if not kids[i]:
                s = 1
            elif greedy:
                s = int(total[i])
            else:
                s = int(best[i]) + (ties[i] >= 2)
            out[i] = s
            p = int(self.parent[i])
            if p >= 0:
                kids[p] += 1
                total[p] += s
                if s > best[p]:
                    best[p], ties[p] = s, 1
                elif s == best[p]:
                    ties[p] += 1
        for i in np.flatnonzero(skip_leaf).tolist():
            end = twig[i][-1]
            if self.n_children[end] > 1:
                out[[x for x in twig[i] if x != end]] = out[end]
        return out

    def prune(self, threshold: float, mask=None, weighted: bool = True) -> np.ndarray:
        """Rows that stay after terminal twigs up to ``threshold`` (inclusive, entry edge counted) go."""
        w = self.weight if weighted else np.ones(self.n)
        may = np.ones(self.n, bool) if mask is None else np.asarray(mask, bool)
        keep = np.ones(self.n, bool)
        for leaf in np.flatnonzero((self.n_children == 0) & may).tolist():
            d, twig, i = 0.0, [], leaf
            while i >= 0 and not d > threshold and may[i] and self.n_children[i] <= 1:
                twig.append(i)
                d += w[i]
                i = int(self.parent[i])
            if d <= threshold:
                keep[twig] = False
        return np.flatnonzero(keep)

    def flow(self, pre, post, mode: str) -> np.ndarray:
        """Synapse flow centrality: distal counts include the node itself, proximal is the component's rest."""
        if mode not in ("centrifugal", "centripetal", "sum"):
            raise ValueError(f"unknown mode: {mode}")
        pre, post = np.asarray(pre, np.int64), np.asarray(post, np.int64)
        below_pre, below_post = self.subtree_sum(pre), self.subtree_sum(post)
        root = self.root()
        out = np.zeros(self.n, np.int64)
        if mode != "centripetal":
            out += (below_post[root] - below_post) * below_pre
        if mode != "centrifugal":
            out += (below_pre[root] - below_pre) * below_post
        return out

    # -- rewiring -------------------------------------------------------------------------------------
    def reroot(self, new_roots) -> np.ndarray:
        """Parent ids after the first wanted root of each component becomes its root."""
        parent = self.parent.copy()
        root, done = self.root(), set()
        for r in self.index(new_roots).tolist():
            if r < 0 or root[r] in done:
                continue
            done.add(root[r])
            path = self.path(r)
            parent[path[0]] = -1
            for a, b in zip(path[:-1], path[1:], strict=True):
                parent[b] = a
        return np.where(parent < 0, -1, self.ids[parent])

    def rewire(self, keep: np.ndarray):
        """Kept rows, their new parent ids, summed weights, and for every row the nearer kept end of its chain.

        Passes over the levels: the nearest kept node above each row with its distance, and the kept node below that ends its chain.
        """
        n, w = self.n, self._edge()
        above, up = np.full(n, -1), np.zeros(n)
        for rows in self.levels:
            p = self.parent[rows]
            stops = keep[p] | (above[p] < 0)
            above[rows] = np.where(keep[p], p, above[p])
            up[rows] = np.where(stops, w[rows], up[p] + w[rows])
        below, low = np.full(n, -1), np.zeros(n)
        for rows in self.levels[::-1]:
            down, d = np.where(keep[rows], rows, below[rows]), np.where(keep[rows], 0.0, low[rows]) + w[rows]
            # the later kept row wins where chains meet
            order = np.argsort(down, kind="stable")
            order = order[(down[order] >= 0) & ~keep[self.parent[rows[order]]]]
            below[self.parent[rows[order]]], low[self.parent[rows[order]]] = down[order], d[order]
        kept = np.flatnonzero(keep)
        has = above[kept] >= 0
        parents, weights = np.where(has, self.ids[above[kept]], -1), np.where(has, up[kept], 0.0)
        near = np.where((above >= 0) & (up <= low), above, below)
        near = np.where(keep, np.arange(n), np.where(below >= 0, near, -1))
        return kept, parents, weights, np.where(near < 0, -1, self.ids[near])

    def topology(self) -> np.ndarray:
        return self.is_root | (self.n_children != 1)

    def longest(self, n: int = 1, min_length: float | None = None, weighted: bool = True) -> list[list[int]]:
        """Up to ``n`` disjoint longest leaf-to-root paths; with a least length the whole catchment is measured."""
        w = self._edge() if weighted else np.where(self.is_root, 0.0, 1.0)
        alive = np.ones(self.n, bool)
        out = []
        for _ in range(n):
            if not alive.any():
                break
            live_edge = alive & ~self.is_root
            live_edge[live_edge] = alive[self.parent[live_edge]]
            deep = self.down(np.zeros(self.n), lambda up, rows, e=live_edge: np.where(e[rows], up + w[rows], 0.0))
            i = int(np.argmax(np.where(alive, deep, -np.inf)))
            path = [i]
            while live_edge[path[-1]]:
                path.append(int(self.parent[path[-1]]))
            if min_length is not None:
                on = np.zeros(self.n, bool)
                on[path] = True
                rows = np.flatnonzero(live_edge)
                if w[rows[on[self.parent[rows]]]].sum() <= min_length:
                    break
            alive[path] = False
            out.append(path)
        return out


def block_distances(source, target, place, end, deep, low, low_deep, directed: bool, step: int = 1 << 19):
    """(position, block of distances of the sources from there on to all targets), by ``labels``; -1 where unreachable.

    Sources and targets are positions among the labels; ``step`` is the most cells of a block, one source at least.
    """
    step = max(1, step // max(1, len(target)))
    p, e, d = place[target], end[target], deep[target]
    starts = np.append(np.flatnonzero(low < 0), len(low))
    line = np.full(len(low), -1.0)
    for k in range(0, len(source), step):
        some = source[k : k + step]
        if directed:
            here = place[some][:, None]
            yield k, np.where((p <= here) & (here < e), deep[some][:, None] - d, -1.0)
            continue
        out = np.empty((len(some), len(target)))
        part = np.searchsorted(starts, some, "right")
        for i, (s, a, b) in enumerate(zip(some.tolist(), starts[part - 1].tolist(), starts[part].tolist(), strict=True)):
            left, right = np.minimum.accumulate(low[a + 1 : s + 1][::-1])[::-1], np.minimum.accumulate(low[s + 1 : b])
            top = np.concatenate([low_deep[left], deep[s : s + 1], low_deep[right]])
            line[a:b] = (deep[s] - top) + (deep[a:b] - top)
            out[i] = line[target]
            line[a:b] = -1.0
        yield k, out


def climb(up: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first ``count`` nodes of the path up from each start, one path after the other, by pointer doubling."""
    out = np.repeat(start, count)
    pos = np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
    k, most = 1, int(count.max(initial=0))
    while k < most:
        rows = np.flatnonzero((pos >= k) & (pos < 2 * k))
        out[rows] = up[out[rows - k]]
        up, k = up[up], 2 * k
    return out


def bfs_rewire(ids, parent_id, new_edges, root=None) -> np.ndarray:
    """Parent ids of a breadth-first forest over the old and new edges (in that order), from ``root``, then by row."""
    f = Forest(ids, parent_id)
    near: list[list[int]] = [[] for _ in range(f.n)]
    for i in np.flatnonzero(~f.is_root).tolist():
        near[i].append(int(f.parent[i]))
        near[int(f.parent[i])].append(i)
    for a, b in new_edges:
        a, b = f.index([a])[0], f.index([b])[0]
        near[a].append(b)
        near[b].append(a)
    parent, seen = np.full(f.n, -1, np.int64), np.zeros(f.n, bool)
    starts = ([int(f.index([root])[0])] if root is not None else []) + list(range(f.n))
    for s in starts:
        if s < 0 or seen[s]:
            continue
        seen[s], queue = True, [s]
        for i in queue:
            for j in near[i]:
                if not seen[j]:
                    seen[j], parent[j] = True, i
                    queue.append(j)
    return np.where(parent < 0, -1, f.ids[parent])


def stitch(coords: np.ndarray, label: np.ndarray, allowed: np.ndarray, max_dist: float = np.inf):
    """Bridges (row, row, length) joining fragments at minimal total length: Boruvka over closest pairs.

    Each point remembers its nearest point outside its fragment. That stays the answer while the two are apart, and later its
    distance is a lower bound, so a round only asks anew for points that could still beat their fragment's best. The largest
    fragment waits for the others, who find it.
    """
    rows = np.flatnonzero(allowed)
    if not len(rows):
        return []
    group = np.unique(label[rows], return_inverse=True)[1].copy()
    xyz = coords[rows]
    index = PointIndex(xyz)
    out = []
    low, near = np.zeros(len(rows)), np.full(len(rows), -1, np.int64)
    while len(np.unique(group)) > 1:
        size = np.bincount(group)
        some = np.flatnonzero(group != int(np.argmax(size)))
        known = (near[some] >= 0) & (group[near[some]] != group[some])
        best = np.full(len(size), np.inf)
        np.minimum.at(best, group[some[known]], low[some[known]])
        # no answer at infinity: nothing is outside, or all is too far
        ask = some[~known & (low[some] <= best[group[some]]) & np.isfinite(low[some])]
        low[ask], near[ask] = index.nearest(xyz[ask], group, group[ask])
        some = some[(near[some] >= 0) & (low[some] < np.inf)]
        some = some[group[near[some]] != group[some]]
        some = some[np.sqrt(low[some]) <= np.nextafter(max_dist, np.inf)]
        if not len(some):
            break
        j, d = near[some], low[some]
        a, b = np.minimum(some, j), np.maximum(some, j)
        order = np.lexsort((b, a, d, group[some]))
        first = order[np.concatenate([[True], np.diff(group[some[order]]) != 0])]
        for v, x, y in sorted(set(zip(d[first].tolist(), a[first].tolist(), b[first].tolist(), strict=True))):
            gx, gy = group[x], group[y]
            if gx != gy:
                out.append((int(rows[x]), int(rows[y]), float(np.sqrt(v))))
                group[group == max(gx, gy)] = min(gx, gy)
    return out
