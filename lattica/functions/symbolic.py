"""Symbolic analysis of one symmetric pattern: elimination tree, postorder, column counts, fill and supernodes.

After Liu (1990), Gilbert, Ng and Peyton (1994) and Davis (2006). A pattern is given by its strictly lower entries (i > j).
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np


#: Entries that are worked on at once, so that a step needs little memory beside the pattern itself.
STEP = 1 << 21


def number_type(n: int) -> type:
    return np.int32 if n < 1 << 31 else np.int64


def sorted_keys(n: int, pairs, most: int) -> np.ndarray:
    """Distinct row * n + column in ascending order, from pieces (rows, columns) of at most that many entries in all."""
    keys, m = np.empty(most, np.int64), 0
    for rows, cols in pairs:
        own = keys[m : m + len(rows)]
        np.multiply(rows, n, out=own, dtype=np.int64)
        own += cols
        m += len(rows)
    keys = keys[:m]
    keys.sort()
    if any((keys[k + 1 : k + 1 + STEP] == keys[k : k + STEP][: m - 1 - k]).any() for k in range(0, m - 1, STEP)):
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return keys


def csr_of(n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row starts, columns) of sorted keys."""
    cols = np.empty(len(keys), number_type(n))
    for k in range(0, len(keys), STEP):
        cols[k : k + STEP] = keys[k : k + STEP] % n
    return np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) * n), cols


def lower_csr(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row starts, columns in ascending order) of the distinct strictly lower entries."""

    def pairs():
        for k in range(0, len(i), STEP):
            a, b = i[k : k + STEP], j[k : k + STEP]
            off = a != b
            yield np.maximum(a, b)[off], np.minimum(a, b)[off]

    return csr_of(n, sorted_keys(n, pairs(), len(i)))


def rows_at_once(starts: np.ndarray):
    """(first, last and one) of runs of rows of about STEP entries in all."""
    n, a = len(starts) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + STEP, "right")) - 1)
        yield a, min(b, n)
        a = b


def transposed(n: int, starts: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column starts, rows in ascending order)."""
    pairs = ((cols[starts[a] : starts[b]], np.repeat(np.arange(a, b), np.diff(starts[a : b + 1]))) for a, b in rows_at_once(starts))
    return csr_of(n, sorted_keys(n, pairs, len(cols)))


def elimination_tree(n: int, starts: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """parent[j], -1 at roots; ancestors are compressed on the way."""
    parent, ancestor = array("q", [-1]) * n, array("q", [-1]) * n
    for a, b in rows_at_once(starts):
        own, ends = cols[starts[a] : starts[b]].tolist(), (starts[a : b + 1] - starts[a]).tolist()
        for i in range(a, b):
            for j in own[ends[i - a] : ends[i - a + 1]]:
                while True:
                    up = ancestor[j]
                    if up == i:
                        break
                    ancestor[j] = i
                    if up == -1:
                        parent[j] = i
                        break
                    j = up
    return np.array(parent, np.int64)


def _children(parent: np.ndarray) -> tuple[array, array]:
    """(each node's smallest child, each child's next sibling), -1 if there is none."""
    n = len(parent)
    head, after = array("q", [-1]) * n, array("q", [-1]) * n
    for j, p in zip(range(n - 1, -1, -1), parent[::-1].tolist(), strict=True):
        if p >= 0:
            after[j], head[p] = head[p], j
    return head, after


def postorder(parent: np.ndarray) -> np.ndarray:
    """Nodes in postorder, children by ascending number."""
    head, after = _children(parent)
    out = array("q")
    for root in np.flatnonzero(parent < 0).tolist():
        stack = [root]
        while stack:
            c = head[stack[-1]]
            if c < 0:
                out.append(stack.pop())
            else:
                head[stack[-1]] = after[c]
                stack.append(c)
    return np.array(out, np.int64)


def levels(parent: np.ndarray) -> np.ndarray:
    """Height above the leaves: 0 at a leaf, one more than the highest child otherwise."""
    out = np.zeros(len(parent), np.int64)
    for j in range(len(parent)):
        if parent[j] >= 0:
            out[parent[j]] = max(out[parent[j]], out[j] + 1)
    return out


def column_counts(n: int, starts: np.ndarray, cols: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Entries of each column of the factor, the diagonal included, in nearly the time of one pass over the pattern: only the
    leaves of the rows' subtrees and the nodes where these meet are counted (Gilbert, Ng and Peyton)."""
    post, par = array("q", postorder(parent).tobytes()), array("q", parent.astype(np.int64).tobytes())
    first, delta = array("q", [-1]) * n, array("q", [0]) * n
    for k, j in enumerate(post):
        delta[j] = 1 if first[j] == -1 else 0
        while j != -1 and first[j] == -1:
            first[j] = k
            j = par[j]
    ends, rows = transposed(n, starts, cols)
    latest, leaf, ancestor = array("q", [-1]) * n, array("q", [-1]) * n, array("q", range(n))
    for j in post:
        f = first[j]
        for i in rows[ends[j] : ends[j + 1]].tolist():
            if f <= latest[i]:
                continue
            latest[i] = f
            delta[j] += 1
            before, leaf[i] = leaf[i], j
            if before != -1:
                q = before
                while q != ancestor[q]:
                    q = ancestor[q]
                delta[q] -= 1
                while before != q:
                    ancestor[before], before = q, ancestor[before]
        if par[j] != -1:
            delta[par[j]] -= 1
            ancestor[j] = par[j]
    for j in range(n):
        if par[j] != -1:
            delta[par[j]] += delta[j]
    return np.array(delta, np.int64)


def _patterns(n: int, starts: np.ndarray, cols: np.ndarray, parent: np.ndarray, begins: np.ndarray):
    """For each run of columns (from one of begins to the next) the rows below it in the factor, in ascending order. What is held
    is the pattern and the rows of those runs whose parent is still to come and which have children of their own."""
    at, rows = transposed(n, starts, cols)
    begins, ends = begins.tolist(), [*begins[1:].tolist(), n]
    above = parent[np.array(ends, np.int64) - 1] if n else parent  # a run's parent is its last column's
    owner = np.searchsorted(np.array(begins), above, "right") - 1
    head, after = _children(np.where(above < 0, -1, owner))
    held: dict[int, np.ndarray] = {}
    mark = np.zeros(n, bool)
    for k, (a, b) in enumerate(zip(begins, ends, strict=True)):
        own, c = [rows[at[a] : at[b]]], head[k]
        while c >= 0:
            own.append(held.pop(c) if c in held else rows[at[begins[c]] : at[ends[c]]])
            c = after[c]
        if len(own) == 1 and b == a + 1:
            yield own[0]
            continue
        r = np.concatenate(own)
        r = r[r >= b]
        if len(r) > (n - b) >> 4:
            mark[r] = True
            r = (np.flatnonzero(mark[b:]) + b).astype(rows.dtype)
            mark[r] = False
        else:
            r = np.unique(r)
        held[k] = r
        if above[k] < 0:
            del held[k]
        yield r


def fill_columns(n: int, starts: np.ndarray, cols: np.ndarray, parent: np.ndarray):
    """The rows below the diagonal of one column after the other."""
    return _patterns(n, starts, cols, parent, np.arange(n))


def fill_pattern(n: int, starts: np.ndarray, cols: np.ndarray, parent: np.ndarray) -> list[np.ndarray]:
    """For each column the rows below the diagonal: its own entries and its children's, without itself."""
    return list(fill_columns(n, starts, cols, parent))


@dataclass
class Front:
    """Columns first to last - 1 of the factor, which share the rows below; parent is a front's number or -1."""

    first: int
    last: int
    rows: np.ndarray
    parent: int = -1


def supernodes(parent: np.ndarray, counts: np.ndarray, widest: int) -> np.ndarray:
    """First columns of the fundamental supernodes: runs of only children whose counts fall by one."""
    n = len(parent)
    only = np.bincount(parent[parent >= 0], minlength=n) == 1
    begins, width = [], 0
    for j in range(n):
        joins = j > 0 and parent[j - 1] == j and counts[j - 1] == counts[j] + 1 and only[j] and width < widest
        width = width + 1 if joins else 1
        if not joins:
            begins.append(j)
    return np.array(begins, np.int64)


def fronts_of(n: int, starts: np.ndarray, cols: np.ndarray, widest: int = 128, slack: float = 0.15, small: int = 16, parent: np.ndarray | None = None, counts: np.ndarray | None = None) -> list[Front]:
    """Fronts of a postordered pattern. A front joins the next one, its parent, where that adds few zeros: the joint
    front has at most small columns, or zeros of at most slack of its entries."""
    parent = elimination_tree(n, starts, cols) if parent is None else parent
    counts = column_counts(n, starts, cols, parent) if counts is None else counts
    begins = supernodes(parent, counts, widest)
    ends = np.append(begins[1:], n)
    out: list[Front] = []
    true: list[int] = []
    for a, b, rows in zip(begins.tolist(), ends.tolist(), _patterns(n, starts, cols, parent, begins), strict=True):
        entries = int(counts[a:b].sum())
        while out and out[-1].last == a and len(out[-1].rows) and a <= out[-1].rows[0] < b:
            child = out[-1]
            first, w = child.first, b - child.first
            joint = np.union1d(child.rows[child.rows >= b], rows)
            size = w * (w + 1) // 2 + w * len(joint)
            if w > widest or (w > small and size - true[-1] - entries > slack * size):
                break
            out.pop()
            a, rows, entries = first, joint, entries + true.pop()
        out.append(Front(a, b, rows))
        true.append(entries)
    owner = np.empty(n, np.int64)
    for k, f in enumerate(out):
        owner[f.first : f.last] = k
    for f in out:
        f.parent = int(owner[f.rows[0]]) if len(f.rows) else -1
    return out
