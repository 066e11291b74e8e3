"""The searches, on plain arrays: what runs in each task over the broadcast graph."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Mean out-degree from which the search over arrays beats the heap.
DENSE_DEGREE = 24
#: Vertices up to which a dense graph is held as matrices, for searches from a block of sources at once.
MATRIX_VERTICES, BLOCK = 2500, 64


@dataclass
class Tree:
    """Best routes from one source: for each settled vertex, in the order of settling, its route's weight, length, number of edges, previous vertex
    and last edge (-1 at the source).
    """

    v: np.ndarray
    w: np.ndarray
    d: np.ndarray
    hops: np.ndarray
    prev: np.ndarray
    edge: np.ndarray


class Csr:
    """A graph as adjacency arrays. Vertices are numbered in the order of their ids; of parallel edges the one with the least (w, d, ord) is kept.

    Ids are coded once, when the graph is loaded; ``names`` and ``ord`` are Arrow arrays, all else numbers.
    """

    def __init__(self, start_id: pa.Array, end_id: pa.Array, w: np.ndarray, d: np.ndarray, ord_: pa.Array, kind: np.ndarray | None = None):
        n_edges = len(w)
        coded = pa.concat_arrays([start_id, end_id]).dictionary_encode()
        rank = pc.sort_indices(coded.dictionary)
        self.names = coded.dictionary.take(rank)
        place = np.empty(len(rank), np.int32)
        place[rank.to_numpy()] = np.arange(len(rank), dtype=np.int32)
        codes = place[coded.indices.to_numpy(zero_copy_only=False)]
        tail, head = codes[:n_edges], codes[n_edges:]
        first = pc.array_sort_indices(ord_)
        by_order = np.empty(n_edges, np.int64)
        by_order[first.to_numpy()] = np.arange(n_edges)
        order = np.lexsort((by_order, d, w, head, tail))
        tail, head = tail[order], head[order]
        new = np.ones(n_edges, bool)
        new[1:] = (tail[1:] != tail[:-1]) | (head[1:] != head[:-1])
        keep = order[new]
        self.tail, self.head = tail[new], head[new]
        self.w, self.d, self.ord = np.asarray(w, float)[keep], np.asarray(d, float)[keep], ord_.take(pa.array(keep))
        self.kind = None if kind is None else np.asarray(kind)[keep]
        self.n = len(self.names)
        self.start = np.searchsorted(self.tail, np.arange(self.n + 1))
        self._lists: tuple | None = None
        self._matrices: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lists": None, "_matrices": None}

    def index(self, ids) -> np.ndarray:
        """Vertex numbers of ``ids`` (an Arrow array, or values); -1 for ids that aren't in the graph."""
        ids = ids if isinstance(ids, pa.Array) else pa.array(list(ids), self.names.type)
        return pc.fill_null(pc.index_in(ids.cast(self.names.type), value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def id_of(self, vertices) -> pa.Array:
        """The ids of vertex numbers, null for -1."""
        at = np.asarray(vertices, np.int64)
        return self.names.take(pa.array(at, mask=at < 0))

    def edge_of(self, edges) -> pa.Array:
        """The graph's own numbers of edges, null for -1."""
        at = np.asarray(edges, np.int64)
        return self.ord.take(pa.array(at, mask=at < 0))

    def lists(self) -> tuple:
        if self._lists is None:
            self._lists = self.start.tolist(), self.head.tolist(), self.w.tolist(), self.d.tolist()
        return self._lists

    def search(self, source: int, targets: Iterable[int] | None = None, limit: float | None = None, nearest: bool = False) -> Tree:
        """Best routes by (w, d, edges, previous vertex). Ends early once all ``targets`` are settled (``nearest``: one of them), or when no open
        route is within ``limit`` of length. Exact: a longer best route is never passed over for a
        shorter one of more weight."""
        dense = self.n and len(self.w) / self.n >= DENSE_DEGREE and limit is None
        return (self._search_arrays if dense else self._search_heap)(source, targets, limit, nearest)

    @property
    def blocks(self) -> bool:
        """Whether blocks of sources are searched together."""
        return bool(self.n and len(self.w) / self.n >= DENSE_DEGREE and self.n <= MATRIX_VERTICES and self.w.min() > 0)

    def searches(self, sources: list[int], targets: Iterable[int] | None = None) -> Iterator[tuple[int, Tree]]:
        """(source, tree) of each of ``sources``; of a dense graph with positive weights, blocks of them are searched together."""
        if self.blocks:
            for at in range(0, len(sources), BLOCK):
                block = sources[at : at + BLOCK]
                yield from zip(block, self._search_block(np.array(block, np.int64)))
        else:
            for s in sources:
                yield s, self.search(s, targets)

    def _search_block(self, sources: np.ndarray) -> Iterator[Tree]:
        """As ``search``, a row of a matrix for each source. With positive weights a vertex' label can only come from vertices of less weight, so it
        doesn't matter in which order equal ones are settled.
        """
        n, rows = self.n, np.arange(len(sources))
        if self._matrices is None:
            ws, ds, ks = np.full((n, n), np.inf), np.zeros((n, n)), np.full((n, n), -1, np.int32)
            ws[self.tail, self.head], ds[self.tail, self.head], ks[self.tail, self.head] = self.w, self.d, np.arange(len(self.w))
            self._matrices = ws, ds, ks
        ws, ds, ks = self._matrices
        shape = (len(sources), n)
        w, d, hops, prev, edge = np.full(shape, np.inf), np.full(shape, np.inf), np.zeros(shape, np.int64), np.full(shape, -1), np.full(shape, -1)
        w[rows, sources] = d[rows, sources] = 0.0
        key, order = w.copy(), np.full(shape, -1)
        for i in range(n):
            v = key.argmin(1)
            least = key[rows, v]
            live = least < np.inf
            if not live.any():
                break
            order[live, i] = v[live]
            key[rows[live], v[live]] = np.inf
            new = least[:, None] + ws[v]
            better = new < w
            tie = (new == w) & (key < np.inf)
            if tie.any():
                r, t = np.nonzero(tie)
                u = v[r]
                nd, nh = d[r, u] + ds[u, t], hops[r, u] + 1
                less = (nd < d[r, t]) | (nd == d[r, t]) & ((nh < hops[r, t]) | (nh == hops[r, t]) & (u < prev[r, t]))
                better[r[less], t[less]] = True
            r, t = np.nonzero(better)
            u = v[r]
            w[r, t] = key[r, t] = new[r, t]
            d[r, t], hops[r, t], prev[r, t], edge[r, t] = d[r, u] + ds[u, t], hops[r, u] + 1, u, ks[u, t]
        for r in rows.tolist():
            at = order[r][order[r] >= 0]
            yield Tree(at, w[r, at], d[r, at], hops[r, at], prev[r, at], edge[r, at])

    def _search_heap(self, source: int, targets, limit, nearest) -> Tree:
        start, head, ws, ds = self.lists()
        label: dict[int, tuple] = {source: (0.0, 0.0, 0, -1, -1)}
        heap = [(0.0, 0.0, 0, -1, source)]
        done: dict[int, tuple] = {}
        wanted = None if targets is None else set(targets)
        open_within = 1
        while heap:
            w, d, hops, p, v = heapq.heappop(heap)
            mine = label[v]
            if v in done or mine[:4] != (w, d, hops, p):
                continue
            done[v] = mine
            if limit is not None and d <= limit:
                open_within -= 1
            if wanted is not None and v in wanted:
                wanted.discard(v)
                if nearest or not wanted:
                    break
            for k in range(start[v], start[v + 1]):
                t = head[k]
                if t in done:
                    continue
                new = (w + ws[k], d + ds[k], hops + 1, v, k)
                old = label.get(t)
                if old is None or new < old:
                    label[t] = new
                    heapq.heappush(heap, (*new[:4], t))
                    if limit is not None:
                        open_within += (new[1] <= limit) - (old is not None and old[1] <= limit)
            if limit is not None and not open_within:
                break
        rows = list(done.values())
        column = lambda i, kind: np.fromiter((r[i] for r in rows), kind, len(rows))
        return Tree(
            np.fromiter(done, np.int64, len(done)), column(0, float), column(1, float), column(2, np.int64), column(3, np.int64), column(4, np.int64)
        )

    def resume(self, label: dict[int, tuple], going: list[int], outside: list[bool], limit: float | None, top: float) -> set[int]:
        """Go on with the routes of one source that are open at ``going``. ``label``: (w, d, edges, id of the previous vertex, the graph's number of the
        edge) of the vertices so far, which is brought up to date; vertices that are ``outside`` get labels and aren't followed. With a limit, ends when no
        open route is within it or has less weight than ``top``, that of the heaviest known route within. Returns the vertices whose routes are still open.
        """
        start, head, ws, ds = self.lists()
        names, ords = self.names, self.ord
        heap, open_ = [(*label[v][:3], v) for v in going], set(going)
        heapq.heapify(heap)
        near = 0 if limit is None else sum(label[v][1] <= limit for v in going)
        while heap:
            w, d, hops, v = heapq.heappop(heap)
            if v not in open_ or label[v][:3] != (w, d, hops):
                continue
            if limit is not None:
                if not near and w >= top:
                    break
                if d <= limit:
                    near, top = near - 1, max(top, w)
            open_.discard(v)
            name = names[v].as_py()
            for k in range(start[v], start[v + 1]):
                t, new = head[k], (w + ws[k], d + ds[k], hops + 1, name)
                old = label.get(t)
                if old is not None and old[:4] <= new:
                    continue
                label[t] = (*new, ords[k].as_py())
                if not outside[t] and (old is None or old[:3] != new[:3]):
                    if limit is not None:
                        near += (new[1] <= limit) - (t in open_ and old[1] <= limit)
                    open_.add(t)
                    heapq.heappush(heap, (*new[:3], t))
        return open_

    def _search_arrays(self, source: int, targets, limit, nearest) -> Tree:
        n = self.n
        w, d, hops, prev, edge = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
        w[source] = d[source] = 0.0
        key = w.copy()  # the weight of open vertices
        wanted = None if targets is None else set(targets)
        order, start, head, ws, ds = [], self.start, self.head, self.w, self.d
        while True:
            v = int(key.argmin())
            if key[v] == np.inf:
                break
            equal = np.flatnonzero(key == key[v])
            if len(equal) > 1:
                v = int(equal[np.lexsort((prev[equal], hops[equal], d[equal]))[0]])
            order.append(v)
            key[v] = np.inf
            if wanted is not None and v in wanted:
                wanted.discard(v)
                if nearest or not wanted:
                    break
            a, z = start[v], start[v + 1]
            t, nw, nd = head[a:z], w[v] + ws[a:z], d[v] + ds[a:z]
            better = nw < w[t]
            tie = (nw == w[t]) & (key[t] < np.inf)
            if tie.any():
                better |= tie & ((nd < d[t]) | (nd == d[t]) & ((hops[v] + 1 < hops[t]) | (hops[v] + 1 == hops[t]) & (v < prev[t])))
            if better.any():
                t = t[better]
                w[t], d[t], hops[t], prev[t], edge[t] = nw[better], nd[better], hops[v] + 1, v, np.arange(a, z)[better]
                key[t] = w[t]
        at = np.array(order, np.int64)
        return Tree(at, w[at], d[at], hops[at], prev[at], edge[at])

    def paths(self, tree: Tree, targets: np.ndarray) -> dict[int, tuple[list[int], list[int]]]:
        """(vertices, edges) of the route to each of ``targets`` that was reached."""
        place = dict(zip(tree.v.tolist(), range(len(tree.v))))
        prev, edge, out = tree.prev.tolist(), tree.edge.tolist(), {}
        for t in targets.tolist():
            if t in place:
                vertices, edges, v = [t], [], t
                while prev[place[v]] >= 0:
                    edges.append(edge[place[v]])
                    v = prev[place[v]]
                    vertices.append(v)
                out[t] = (vertices[::-1], edges[::-1])
        return out

    def load(self, tree: Tree, flow: dict[int, float], norm: bool, onto: np.ndarray) -> None:
        """Add to ``onto`` (by edge) the ``flow`` to each vertex, on all edges of its route; with ``norm`` divided by their number. Back from the far
        ends, so each tree edge is visited once.
        """
        held = dict.fromkeys(tree.v.tolist(), 0.0)
        rows = list(zip(tree.v.tolist(), tree.hops.tolist(), tree.prev.tolist(), tree.edge.tolist()))
        for v, hops, _p, _k in rows:
            f = flow.get(v)
            if f and hops:
                held[v] += f / hops if norm else f
        for v, hops, p, k in reversed(rows):
            if hops and held[v]:
                onto[k] += held[v]
                held[p] += held[v]

    def brandes(self, source: int, threshold: float | None, weight: float, edges: bool, onto: np.ndarray) -> None:
        """Add the dependency of ``source`` on each edge or vertex: the shares of shortest routes (by w, ties all counted) that use it."""
        start, head, ws, _ = self.lists()
        dist = {source: 0.0}
        sigma: dict[int, int] = {source: 1}
        before: dict[int, list[tuple[int, int]]] = {source: []}
        heap, done, stack = [(0.0, source)], set(), []
        while heap:
            w, v = heapq.heappop(heap)
            if v in done or w > dist[v]:
                continue
            done.add(v)
            if threshold is not None and w > threshold:
                continue
            stack.append(v)
            for k in range(start[v], start[v + 1]):
                t, new = head[k], w + ws[k]
                old = dist.get(t)
                if t == v or t in done and (old is None or new > old):
                    continue
                if old is None or new < old:
                    dist[t], sigma[t], before[t] = new, sigma[v], [(v, k)]
                    heapq.heappush(heap, (new, t))
                elif new == old and t not in done:
                    sigma[t] += sigma[v]
                    before[t].append((v, k))
        delta = dict.fromkeys(stack, 0.0)
        for v in reversed(stack):
            share = (1.0 + delta[v]) / sigma[v]
            for p, k in before[v]:
                part = sigma[p] * share
                delta[p] += part
                if edges:
                    onto[k] += weight * part
            if not edges and v != source:
                onto[v] += weight * delta[v]


def convex_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the convex hull, counter-clockwise from the leftmost point (monotone chain)."""
    order = np.lexsort((y, x))
    order = order[np.concatenate([[True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)])] if len(order) else order
    if len(order) < 3:
        return order
    px, py = x.tolist(), y.tolist()

    def half(points: list[int]) -> list[int]:
        out: list[int] = []
        for p in points:
            while len(out) > 1 and (px[out[-1]] - px[out[-2]]) * (py[p] - py[out[-2]]) - (py[out[-1]] - py[out[-2]]) * (px[p] - px[out[-2]]) <= 0:
                out.pop()
            out.append(p)
        return out

    points = order.tolist()
    return np.array(half(points)[:-1] + half(points[::-1])[:-1])


def concave_hull(x: np.ndarray, y: np.ndarray, concavity: float, length_threshold: float = 0.0) -> np.ndarray:
    """The convex hull dug inwards: a side longer than ``length_threshold`` takes in the nearest inner point whose two new sides are, by the side's
    length, short enough for ``concavity`` (0: convex, up to 1: deepest).
    """
    hull = convex_hull(x, y).tolist()
    if concavity <= 0 or len(hull) < 3:
        return np.array(hull)
    ratio = 1.0 / max(concavity, 1e-6)
    free = np.setdiff1d(np.arange(len(x)), hull)
    queue, out = list(zip(hull, hull[1:] + hull[:1])), []
    while queue:
        a, b = queue.pop(0)
        side = float(np.hypot(x[a] - x[b], y[a] - y[b]))
        best = -1
        if side > length_threshold and len(free):
            to_a, to_b = np.hypot(x[free] - x[a], y[free] - y[a]), np.hypot(x[free] - x[b], y[free] - y[b])
            inner = (x[b] - x[a]) * (y[free] - y[a]) - (y[b] - y[a]) * (x[free] - x[a]) > 0
            near = np.where(inner & (np.maximum(to_a, to_b) < side) & (np.minimum(to_a, to_b) * ratio < side), to_a + to_b, np.inf)
            if len(near) and near.min() < np.inf:
                best = int(near.argmin())
        if best < 0:
            out.append(a)
        else:
            p = int(free[best])
            free = np.delete(free, best)
            queue[:0] = [(a, p), (p, b)]
    return np.array(out)


def fundamental_cycles(tail: np.ndarray, head: np.ndarray) -> list[list[int]]:
    """A basis of the cycles of an undirected graph, each as its vertices in order: a spanning forest, and for each edge beyond it the symmetric
    difference of the two root paths.
    """
    near: dict[int, list[int]] = {}
    for a, b in sorted({(min(a, b), max(a, b)) for a, b in zip(tail.tolist(), head.tolist()) if a != b}):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    parent: dict[int, int] = {}
    depth: dict[int, int] = {}
    cycles = []
    for root in sorted(near):
        if root in parent:
            continue
        parent[root], depth[root], level = -1, 0, [root]
        while level:
            above: dict[int, int] = {}
            for v in level:  # in order, so the least neighbour of the level above comes first
                for t in near[v]:
                    if t not in parent:
                        above.setdefault(t, v)
            for t, v in above.items():
                parent[t], depth[t] = v, depth[v] + 1
            level = sorted(above)
    for a in sorted(near):
        for b in near[a]:
            if a < b and parent[a] != b and parent[b] != a:
                left, right = [a], [b]
                while left[-1] != right[-1]:
                    side = left if depth[left[-1]] >= depth[right[-1]] else right
                    side.append(parent[side[-1]])
                cycles.append(left + right[-2::-1])
    return cycles
