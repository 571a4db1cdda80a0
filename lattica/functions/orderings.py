"""Fill-reducing orderings of one symmetric graph. Each gives the old number of each new one.

Reverse Cuthill-McKee: Cuthill and McKee (1969), George and Liu (1981). Minimum degree: after Amestoy, Davis and Duff (1996),
here with exact degrees on a quotient graph. Nested dissection: George (1973), by the middle level of a breadth-first search.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

from .components import merge
from .symbolic import csr_of, lower_csr, rows_at_once, sorted_keys, transposed


class Graph:
    """Adjacency without the diagonal, both ways."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray):
        # Lower neighbours come before upper ones, each from its own sorted half.
        ends, lower = lower_csr(n, i, j)
        begins, upper = transposed(n, ends, lower)
        self.n = n
        self.degree = np.diff(ends) + np.diff(begins)
        self.starts = np.concatenate(([0], np.cumsum(self.degree)))
        self.cols = np.empty(len(lower) + len(upper), lower.dtype)
        for starts, own, ahead in ((ends, lower, 0), (begins, upper, np.diff(ends))):
            shift = self.starts[:-1] + ahead - starts[:-1]
            for a, b in rows_at_once(starts):
                self.cols[np.repeat(shift[a:b], np.diff(starts[a : b + 1])) + np.arange(starts[a], starts[b])] = own[starts[a] : starts[b]]

    def lower(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """lower_csr of the nodes numbered by place."""

        def pairs():
            for a, b in rows_at_once(self.starts):
                rows, cols = place[np.repeat(np.arange(a, b), self.degree[a:b])], place[self.cols[self.starts[a] : self.starts[b]]]
                low = rows > cols
                yield rows[low], cols[low]

        return csr_of(self.n, sorted_keys(self.n, pairs(), len(self.cols) // 2))

    def near(self, v: int) -> np.ndarray:
        return self.cols[self.starts[v] : self.starts[v + 1]]

    def near_all(self, nodes: np.ndarray) -> np.ndarray:
        """The neighbours of all of nodes, one after another."""
        sizes = self.degree[nodes]
        shift = np.repeat(self.starts[nodes] - np.cumsum(sizes) + sizes, sizes)
        return self.cols[shift + np.arange(len(shift))]

    def pieces(self, nodes: np.ndarray):
        """nodes, some at a time, so that their neighbours are STEP or so."""
        sizes = np.concatenate(([0], np.cumsum(self.degree[nodes])))
        return (nodes[a:b] for a, b in rows_at_once(sizes))


def identity(g: Graph) -> np.ndarray:
    return np.arange(g.n)


def _levels(g: Graph, root: int, inside: np.ndarray) -> list[np.ndarray]:
    """Breadth-first levels of root's component within the nodes marked inside."""
    seen, level, out = ~inside, np.array([root]), []
    seen[root] = True
    while len(level):
        out.append(level)
        found = []
        for own in g.pieces(level):
            after = g.near_all(own)
            after = np.unique(after[~seen[after]])
            seen[after] = True
            found.append(after)
        level = np.sort(np.concatenate(found))
    return out


def _far_root(g: Graph, root: int, inside: np.ndarray) -> list[np.ndarray]:
    """Levels from a node that is nearly as far as any from another."""
    own = _levels(g, root, inside)
    while True:
        last = own[-1]
        other = _levels(g, int(last[np.argmin(g.degree[last])]), inside)
        if len(other) <= len(own):
            return own
        own = other


def reverse_cuthill_mckee(g: Graph) -> np.ndarray:
    seen, out = np.zeros(g.n, bool), []
    for root in np.argsort(g.degree, kind="stable").tolist():
        if seen[root]:
            continue
        root = int(_far_root(g, root, ~seen)[0][0])
        queue, at = [root], 0
        seen[root] = True
        while at < len(queue):
            near = g.near(queue[at])
            near = near[~seen[near]]
            near = near[np.argsort(g.degree[near], kind="stable")]
            seen[near] = True
            queue += near.tolist()
            at += 1
        out += queue
    return np.array(out[::-1], np.int64)


def minimum_degree(g: Graph, most_bytes: int = 1 << 28) -> np.ndarray:
    """Nodes by their exact degree in what is left, ties by number. Rows of nodes with fill are bitmaps while these take
    at most most_bytes, so that nodes of many neighbours cost little; where more have fill, a quotient graph takes over."""
    order = _minimum_degree_rows(g, most_bytes)
    return _minimum_degree_sets(g) if order is None else order


def _minimum_degree_rows(g: Graph, most_bytes: int) -> np.ndarray | None:
    """Eliminated nodes join their neighbours' rows; None if the rows would take over most_bytes."""
    n = g.n
    words, degree, row = -(-n // 64), g.degree.copy(), np.full(n, -1)
    bits, used = np.zeros((0, words), np.uint64), 0
    heap = [(d, v) for v, d in enumerate(degree.tolist())]
    heapify(heap)
    done, out = np.zeros(n, bool), []
    while heap:
        d, v = heappop(heap)
        if done[v] or d != degree[v]:
            continue
        done[v] = True
        out.append(v)
        if not d:
            continue
        if d == n - len(out):  # what is left is complete: it goes by number
            return np.array(out + np.flatnonzero(~done).tolist(), np.int64)
        own = g.near(v) if row[v] < 0 else np.flatnonzero(np.unpackbits(bits[row[v]].view(np.uint8), count=n, bitorder="little"))
        for u in own[row[own] < 0].tolist():
            if used == len(bits):
                if (used + 1) * words * 8 > most_bytes:
                    return None
                more = max(1, min(max(used, 16), most_bytes // (8 * words) - used))
                bits = np.concatenate((bits, np.zeros((more, words), np.uint64)))
            mark = np.zeros(64 * words, np.uint8)
            mark[g.near(u)] = 1
            bits[used] = np.packbits(mark, bitorder="little").view(np.uint64)
            row[u], used = used, used + 1
        at = row[own]
        mark = np.zeros(64 * words, np.uint8)
        mark[own] = 1
        block = bits[at] | np.packbits(mark, bitorder="little").view(np.uint64)
        block[:, v >> 6] &= ~np.uint64(1 << (v & 63))
        block[np.arange(len(own)), own >> 6] &= ~(np.uint64(1) << (own & 63).astype(np.uint64))
        bits[at] = block
        degree[own] = np.bitwise_count(block).sum(axis=1, dtype=np.int64)
        for x in zip(degree[own].tolist(), own.tolist(), strict=True):
            heappush(heap, x)
    return np.array(out, np.int64)


def _minimum_degree_sets(g: Graph) -> np.ndarray:
    """Eliminated nodes become elements; a node's neighbours are those left and those of its elements."""
    near = [set(g.near(v).tolist()) for v in range(g.n)]
    elements: list[set[int]] = [set() for _ in range(g.n)]
    members: dict[int, set[int]] = {}
    degree = g.degree.tolist()
    heap = [(d, v) for v, d in enumerate(degree)]
    heapify(heap)
    done, out = [False] * g.n, []
    while heap:
        d, v = heappop(heap)
        if done[v] or d != degree[v]:
            continue
        done[v] = True
        out.append(v)
        own = set(near[v])
        for e in elements[v]:
            own |= members.pop(e)
        own.discard(v)
        members[v] = own
        for u in own:
            near[u] -= own
            near[u].discard(v)
            elements[u] -= elements[v]
            elements[u].add(v)
        for u in own:
            reach = set(near[u])
            for e in elements[u]:
                reach |= members[e]
            degree[u] = len(reach) - (u in reach)
            heappush(heap, (degree[u], u))
    return np.array(out, np.int64)


def nested_dissection(g: Graph, leaf: int = 48) -> np.ndarray:
    """Halves first, then the separator; parts of at most leaf nodes by degree."""
    out: list[int] = []

    def place(nodes: np.ndarray) -> None:
        jobs = [("part", nodes)]
        while jobs:
            kind, own = jobs.pop()
            if kind == "done" or len(own) <= leaf:
                out.extend(own[np.argsort(g.degree[own], kind="stable")].tolist() if kind == "part" else own.tolist())
                continue
            inside = np.zeros(g.n, bool)
            inside[own] = True
            lev = _far_root(g, int(own[0]), inside)
            reached = np.concatenate(lev)
            rest = np.setdiff1d(own, reached)
            if len(rest):
                # All components at once: a separator may leave very many.
                label = np.arange(g.n)
                for some in g.pieces(own):
                    near, at = g.near_all(some), np.repeat(some, g.degree[some])
                    merge(label, at[inside[near]], near[inside[near]])
                by = own[np.argsort(label[own], kind="stable")]
                cuts = np.flatnonzero(np.diff(label[by])) + 1
                jobs += [("part", x) for x in reversed(np.split(by, cuts))]
                continue
            if len(lev) < 3:
                out.extend(own[np.argsort(g.degree[own], kind="stable")].tolist())
                continue
            sizes = np.cumsum([len(x) for x in lev])
            m = min(max(1, int(np.searchsorted(sizes, sizes[-1] / 2))), len(lev) - 2)
            jobs += [("done", lev[m]), ("part", np.concatenate(lev[m + 1 :])), ("part", np.concatenate(lev[:m]))]

    if g.n:
        place(np.arange(g.n))
    return np.array(out, np.int64)


def dense_last(g: Graph, inner, factor: float = 6.0) -> np.ndarray:
    """Nodes of over factor times the mean degree go last; inner orders the others."""
    mean = g.degree.mean() if g.n else 0
    heavy = g.degree > factor * max(mean, 1)
    if not heavy.any() or heavy.all():
        return inner(g)
    light = np.flatnonzero(~heavy)
    number = np.full(g.n, -1)
    number[light] = np.arange(len(light))
    kept = []
    for own in g.pieces(light):
        rows, cols = np.repeat(own, g.degree[own]), g.near_all(own)
        keep = ~heavy[cols] & (cols < rows)
        kept.append((number[rows[keep]], number[cols[keep]]))
    sub = Graph(len(light), *map(np.concatenate, zip(*kept, strict=True)))
    last = np.flatnonzero(heavy)
    return np.concatenate((light[inner(sub)], last[np.argsort(g.degree[last], kind="stable")]))


ORDERINGS = {
    "identity": identity,
    "rcm": reverse_cuthill_mckee,
    "min_degree": minimum_degree,
    "nested_dissection": nested_dissection,
    "dense_last": lambda g: dense_last(g, minimum_degree),
}
