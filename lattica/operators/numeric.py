"""Factorisation, solves, inverses and queries for many matrices at once.

Matrices are keyed by (matrix_id, call_id): calls of one matrix share its pattern and differ in values. Each is worked on by one task;
the pattern's analysis is kept by the Python worker and reused by later calls of the same pattern. A factor is a table with
a row for each front, and one of front -1 for the whole:

    matrix_id, call_id, front, first, rows, block, n, nnz_l, logdet, ordering, status

Row -1 has the order (old number of each new one) in rows; a front has its first column, the rows below its columns
and its block by rows. Status is ok, not_spd, bad_index, duplicate, empty or no_value; without ok there are no fronts.

Entries with a part (parts.py) are worked on by one task for each part. Their factor has a row of front -1 for each part besides, with part
and top (the largest index and one); summaries are of whole matrices, each part has its own ordering.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..functions import kernels
from ..functions import symbolic as symbolic_of

FACTOR = "matrix_id string, call_id long, front int, first long, rows array<long>, block array<double>, n long, nnz_l long, logdet double, ordering string, status string"
_COLUMNS = [c.split()[0] for c in FACTOR.split(", ")]
KEYS = ["matrix_id", "call_id"]
_PART = ", part long, top long"
#: The first of these that a part has is its matrix's.
_STATUSES = ["bad_index", "no_value", "duplicate", "bad_order", "not_spd", "empty", "ok"]


def _keys(df: DataFrame) -> list[str]:
    return [*KEYS, "part"] if "part" in df.columns else KEYS


def with_calls(entries: DataFrame) -> DataFrame:
    return entries if "call_id" in entries.columns else entries.withColumn("call_id", F.lit(0).cast("long"))


def _analysis(n, i, j, conf: EngineConf, user):
    """One analysis for each pattern and worker; the last 64 are kept, fewer if their patterns take over 32 MB."""
    made = lambda: kernels.analyse(n, i, j, conf.ordering_list, user, conf.dense_below, conf.widest_front, not conf.symbolic_only)
    if i.nbytes + j.nbytes > 1 << 25:
        return made()
    key = (n, i.tobytes(), j.tobytes(), conf.orderings, conf.dense_below, conf.widest_front, conf.symbolic_only, None if user is None else user.tobytes())
    kept = sys.__dict__.setdefault("_lattica_patterns", {})
    if key not in kept:
        while kept and (len(kept) >= 64 or sum(len(k[1]) + len(k[2]) for k in (*kept, key)) > 1 << 25):
            kept.pop(next(iter(kept)))
        kept[key] = made()
    return kept[key]


def _status_of(i: np.ndarray, j: np.ndarray, v: np.ndarray | None) -> str:
    """Of entries in the order of (j, i); nulls are -1 and no number. Without v, values aren't looked at."""
    if (i < 0).any() or (j < 0).any() or (j > i).any():
        return "bad_index"
    if v is not None and not np.isfinite(v).all():
        return "no_value"
    if ((i[1:] == i[:-1]) & (j[1:] == j[:-1])).any():
        return "duplicate"
    return "ok"


def _gathered(batches, *columns: str) -> list[np.ndarray]:
    """Those columns of a group's batches: indices in 32 bits if they fit, nulls as -1, and v, nulls as not a number."""
    parts: list[list[np.ndarray]] = [[] for _ in columns]
    for batch in batches:
        for c, name in zip(parts, columns, strict=True):
            own = batch.column(batch.schema.get_field_index(name))
            if name == "v":
                c.append(own.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).copy())
            else:
                own = own.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
                c.append(own.astype(np.int32) if len(own) and -(1 << 31) <= own.min() and own.max() < 1 << 31 else own.copy())
    out = []
    for c in parts:
        out.append(np.concatenate(c) if c else np.zeros(0, np.int64))
        c.clear()
    return out


def _batch(rows: dict, schema: str) -> pa.RecordBatch:
    """rows (columns of one length) with the names and types of schema; strings may be one value for all."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    size = max(len(x) for x in rows.values() if isinstance(x, (list, np.ndarray)))
    names, arrays = [], []
    for field in schema.split(", "):
        name, kind = field.split()
        x = rows[name]
        names.append(name)
        arrays.append(pa.array(x, kinds[kind]) if isinstance(x, (list, np.ndarray)) else pa.repeat(pa.scalar(x, kinds[kind]), size))
    return pa.record_batch(arrays, names)


def _numbered(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the nodes of a part in ascending order, i and j as places among them)."""
    top = int(max(i.max(), j.max())) + 1
    if min(i.min(), j.min()) < 0 or top > 4 * len(i) + 1_000_000:
        nodes = np.unique(np.concatenate((i, j)))
        return nodes, np.searchsorted(nodes, i), np.searchsorted(nodes, j)
    mark = np.zeros(top, bool)
    mark[i] = mark[j] = True
    nodes = np.flatnonzero(mark)
    if len(nodes) == top:
        return nodes, i, j
    place = (np.cumsum(mark) - 1).astype(i.dtype)
    return nodes, place[i], place[j]


def _symbolic_row(head: dict, batches, conf: EngineConf) -> dict:
    """The row of front -1 without factoring: values are looked at, not kept."""
    finite = True

    def pairs():
        nonlocal finite
        for batch in batches:
            i, j, v = _gathered([batch], "i", "j", "v")
            finite = finite and bool(np.isfinite(v).all())
            yield batch.select(["i", "j"])

    i, j = _gathered(pairs(), "i", "j")
    if not len(i):
        return head
    status = _status_of(i, j, None)
    if status == "bad_index" or not finite:
        return head | {"status": "bad_index" if status == "bad_index" else "no_value"}
    n = top = int(i.max()) + 1
    keys = symbolic_of.sorted_keys(n, [(i, j)], len(i))
    if len(keys) < len(i):
        return head | {"status": "duplicate"}
    del keys
    nodes = None
    if "part" in head:
        nodes, i, j = _numbered(i, j)
        n = len(nodes)
    graph = kernels.Graph(n, i, j)
    del i, j
    s = kernels.analyse(n, None, None, conf.ordering_list, None, conf.dense_below, fronts=False, graph=graph)
    return head | {"status": "ok", "n": n, "nnz_l": s.nnz_l, "ordering": s.ordering, "rows": s.order if nodes is None else nodes[s.order]} | ({"top": top} if "part" in head else {})


def _head(key) -> dict:
    head = {"matrix_id": key[0], "call_id": key[1], "front": -1, "first": 0, "rows": [], "block": [], "n": 0, "nnz_l": 0, "logdet": None, "ordering": None, "status": "empty"}
    return head | ({"part": key[2], "top": 0} if len(key) > 2 else {})


def _factored(key, i: np.ndarray, j: np.ndarray, v: np.ndarray, conf: EngineConf, user=None, blocks: bool = True):
    """The factor's rows as dicts, fronts as they are made and the row of front -1 at last; without blocks that one alone."""
    head = _head(key)
    if not len(i):
        yield head
        return
    order = np.lexsort((i, j))  # sums don't depend on the order of arrival
    i, j, v = i[order], j[order], v[order]
    del order
    head["status"] = _status_of(i, j, v)
    if head["status"] != "ok":
        yield head
        return
    n = int(i.max()) + 1
    nodes = None
    if len(key) > 2:
        head["top"] = n
        nodes, i, j = _numbered(i, j)
        n = len(nodes)
    if user is not None and (len(user) != n or not np.array_equal(np.sort(user), np.arange(n))):
        yield head | {"status": "bad_order", "n": n}
        return
    s = _analysis(n, i, j, conf, user)
    head |= {"n": n, "nnz_l": s.nnz_l, "ordering": s.ordering, "rows": s.order if nodes is None else nodes[s.order]}
    if conf.symbolic_only:
        yield head
        return
    made = kernels.factor_blocks(s, i, j, v)
    try:
        if blocks:
            made = list(made)  # a matrix that isn't definite has no fronts
        total = kernels.logdet_of(made)
    except kernels.NotPositiveDefinite:
        yield head | {"status": "not_spd"}
        return
    if blocks:
        for k, f in enumerate(s.fronts):
            yield head | {"front": k, "first": f.first, "rows": f.rows, "block": made[k].ravel(), "logdet": None}
            made[k] = None
    yield head | {"logdet": total}


def _batches(rows, schema: str, most: int = 1 << 21):
    """Record batches of dicts, most numbers in the arrays of each (or one row)."""
    names, held, size = [c.split()[0] for c in schema.split(", ")], [], 0
    for row in rows:
        held.append(row)
        size += 8 + len(row.get("rows", ())) + len(row.get("block", ()))
        if size >= most:
            yield _batch({c: [r[c] for r in held] for c in names}, schema)
            held, size = [], 0
    if held:
        yield _batch({c: [r[c] for r in held] for c in names}, schema)


def _by_group(entries: DataFrame, keys: list[str], conf: EngineConf, schema: str, blocks: bool) -> DataFrame:
    """Streams each group's entries in and the factor's rows out."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = [x.as_py() for x in key]
        if conf.symbolic_only:
            yield from _batches([_symbolic_row(_head(key), batches, conf)], schema)
        else:
            yield from _batches(_factored(key, *_gathered(batches, "i", "j", "v"), conf, blocks=blocks), schema)

    return entries.groupBy(*keys).applyInArrow(run, schema)


def cholesky(entries: DataFrame, conf: EngineConf | None = None, order: DataFrame | None = None) -> DataFrame:
    """The factor of every matrix of entries(matrix_id[, call_id], i, j, v); order(matrix_id, old_id, new_id) fixes the ordering.

    n is the largest index and one. A matrix that can't be factored gives its status instead; the others aren't touched.
    """
    conf = conf or EngineConf()
    keys = _keys(entries)
    own = with_calls(entries).select(*keys, "i", "j", "v")
    if order is None:
        return _by_group(own, keys, conf, FACTOR + _PART if "part" in keys else FACTOR, True)
    if "part" in keys:
        raise ValueError("an order is of a whole matrix")
    calls = own.select(*KEYS).distinct()
    # Aliases, as both sides of the cogroup may come from one table.
    perm = order.join(calls, "matrix_id").select(*(F.col(c).alias(c) for c in (*KEYS, "old_id", "new_id")))

    def run(key, pdf, p):
        p = p.sort_values("new_id")
        user = p["old_id"].to_numpy(np.int64)
        # Ids that miss or repeat make no order of 0 to n - 1.
        user = user if p["new_id"].is_unique else np.zeros(0, np.int64)
        i, j = (pdf[c].fillna(-1).to_numpy(np.int64) for c in ("i", "j"))
        return pd.DataFrame(list(_factored(key, i, j, pdf["v"].to_numpy(float), conf, user)), columns=_COLUMNS)

    return own.groupBy(*KEYS).cogroup(perm.groupBy(*KEYS)).applyInPandas(run, FACTOR)


def _loaded(pdf: pd.DataFrame) -> tuple[kernels.Factor | None, np.ndarray]:
    """(the factor in a group of rows, or None if its status isn't ok; its nodes in ascending order)."""
    heads = pdf[pdf["front"] == -1]
    if not len(heads) or heads["status"].iloc[0] != "ok":
        return None, np.zeros(0, np.int64)
    order, fronts, blocks = np.asarray(heads["rows"].iloc[0], np.int64), [], []
    nodes = np.sort(order)
    order = np.searchsorted(nodes, order)
    for first, rows, block in pdf[pdf["front"] >= 0].sort_values("front")[["first", "rows", "block"]].itertuples(index=False):
        rows, block = np.asarray(rows, np.int64), np.asarray(block, float)
        # The block has w + len(rows) rows of w columns.
        m = len(rows)
        w = int(round((-m + (m * m + 4 * len(block)) ** 0.5) / 2))
        fronts.append(kernels.Front(int(first), int(first) + w, rows))
        blocks.append(block.reshape(w + m, w))
    owner = np.empty(len(order), np.int64)
    for k, f in enumerate(fronts):
        owner[f.first : f.last] = k
    for f in fronts:
        f.parent = int(owner[f.rows[0]]) if len(f.rows) else -1
    return kernels.Factor(kernels.Symbolic(len(order), str(heads["ordering"].iloc[0]), order, fronts, int(heads["nnz_l"].iloc[0])), blocks), nodes


def summary(factor: DataFrame) -> DataFrame:
    """One row per matrix and call: n, nnz_l, logdet (null unless status is ok), ordering, status."""
    heads = factor.where("front = -1")
    return _whole(heads) if "part" in factor.columns else heads.select(*KEYS, "n", "nnz_l", "logdet", "ordering", "status")


def _whole(heads: DataFrame) -> DataFrame:
    """The summary of whole matrices from the rows of their parts; ordering is mixed if parts differ in it. A matrix without an
    entry at some index below its largest is singular."""
    place = F.array_position(F.array(*[F.lit(x) for x in _STATUSES]), F.col("status"))
    own = heads.groupBy(*KEYS).agg(F.max("top").alias("n"), F.sum("n").alias("filled"), F.sum("nnz_l").alias("nnz_l"), F.sum("logdet").alias("logdet"), F.min("ordering").alias("ordering"), F.max("ordering").alias("other"), F.min(place).alias("place"))
    status = F.when((F.col("place") == len(_STATUSES)) & (F.col("filled") < F.col("n")), "not_spd").otherwise(F.element_at(F.array(*[F.lit(x) for x in _STATUSES]), F.col("place").cast("int")))
    own = own.withColumn("status", status).withColumn("unread", F.col("place") <= 3)
    of = lambda c, other: F.when(F.col("unread"), F.lit(other)).otherwise(F.col(c)).alias(c)
    ordering = F.when(~F.col("unread"), F.when(F.col("ordering") == F.col("other"), F.col("ordering")).otherwise("mixed"))
    return own.select(*KEYS, of("n", 0), of("nnz_l", 0), F.when(F.col("status") == "ok", F.col("logdet")).alias("logdet"), ordering.alias("ordering"), "status")


def logdet(entries: DataFrame, conf: EngineConf | None = None) -> DataFrame:
    """summary() of the factor without writing any: fronts stay in the tasks."""
    conf = conf or EngineConf()
    keys = _keys(entries)
    own = with_calls(entries).select(*keys, "i", "j", "v")
    schema = "matrix_id string, call_id long, n long, nnz_l long, logdet double, ordering string, status string" + (_PART if "part" in keys else "")
    out = _by_group(own, keys, conf, schema, False)
    return _whole(out) if "part" in keys else out


def _not_parted(factor: DataFrame) -> None:
    if "part" in factor.columns:
        raise ValueError("parts have orders and factors of their own")


def permutations(factor: DataFrame) -> DataFrame:
    """perm(matrix_id, old_id, new_id) of the factor's ordering; calls of one matrix share it."""
    _not_parted(factor)
    heads = factor.where("front = -1").groupBy("matrix_id").agg(F.min_by("rows", "call_id").alias("rows"))
    return heads.select("matrix_id", F.posexplode("rows").alias("new_id", "old_id")).select("matrix_id", "old_id", F.col("new_id").cast("long").alias("new_id"))


def factor_entries(factor: DataFrame) -> DataFrame:
    """(matrix_id, call_id, i, j, v) of the factor in its own order, without the zeros that only a front's shape holds."""
    _not_parted(factor)

    def run(key, pdf):
        own, _ = _loaded(pdf)
        if own is None:
            return pd.DataFrame({"matrix_id": [], "call_id": [], "i": [], "j": [], "v": []})
        i, j, v = own.entries()
        keep = v != 0
        return pd.DataFrame({"matrix_id": key[0], "call_id": key[1], "i": i[keep].astype(np.int64), "j": j[keep].astype(np.int64), "v": v[keep]})

    return factor.groupBy(*KEYS).applyInPandas(run, "matrix_id string, call_id long, i long, j long, v double")


def solve(factor: DataFrame, rhs: DataFrame, part: str = "full", own_rows: bool = False) -> DataFrame:
    """rhs(matrix_id, call_id, rhs_id, i, b) to the same with x: A x = b, or one sweep (forward, backward) alone.

    Rows without b count as 0. Right-hand sides of a matrix without a factor get null. Of a factor of parts rhs has a part, too; a
    part without rows of a right-hand side gives none of the result, where x is 0. With own_rows x is given at the rows of rhs only,
    and only what these need is worked on.
    """
    if part not in ("full", "forward", "backward"):
        raise ValueError("part is full, forward or backward")

    def run(key, pdf, b):
        ids = np.sort(b["rhs_id"].unique())
        own, nodes = _loaded(pdf)
        if own is None and len(b):
            nodes = np.arange(int(b["i"].max()) + 1) if len(key) == 2 else np.unique(b["i"].to_numpy(np.int64))
        if own_rows:
            i, k = b["i"].to_numpy(np.int64), b["rhs_id"].to_numpy(np.int64)
            x = own.solve_at(np.searchsorted(nodes, i), k, b["b"].fillna(0.0).to_numpy(float), part) if own and len(i) else np.full(len(i), np.nan)
            out = pd.DataFrame({"matrix_id": key[0], "call_id": key[1], "rhs_id": k, "i": i, "x": x})
            return out.astype({"x": object}).where(out.notna(), None) if own is None else out
        n = len(nodes)
        m = np.zeros((n, len(ids)))
        m[np.searchsorted(nodes, b["i"].to_numpy(np.int64)), np.searchsorted(ids, b["rhs_id"])] = b["b"].fillna(0.0)
        x = own.solve(m, part).T.ravel() if own and len(ids) else np.full(n * len(ids), np.nan)
        out = pd.DataFrame({"matrix_id": key[0], "call_id": key[1], "rhs_id": np.repeat(ids, n).astype(np.int64), "i": np.tile(nodes, len(ids)), "x": x})
        return out.astype({"x": object}).where(out.notna(), None) if own is None else out

    keys = _keys(factor)
    rhs = rhs.select(*(F.col(c).alias(c) for c in (*keys, "rhs_id", "i", "b")))
    return factor.groupBy(*keys).cogroup(rhs.groupBy(*keys)).applyInPandas(run, "matrix_id string, call_id long, rhs_id long, i long, x double")


def selected_inverse(factor: DataFrame, diagonal: bool = False) -> DataFrame:
    """(matrix_id, call_id, i, j, z): entries of the inverse on the factor's pattern, i >= j, in the original order; or the diagonal's alone."""
    schema = "matrix_id string, call_id long, i long, j long, z double"

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = [x.as_py() for x in key]
        own, nodes = _loaded(pd.concat([b.to_pandas() for b in batches], ignore_index=True))
        i, j, z, held = [], [], [], 0

        def made():
            return _batch({"matrix_id": key[0], "call_id": key[1], "i": np.concatenate(i), "j": np.concatenate(j), "z": np.concatenate(z)}, schema)

        for k, block in own.inverse_fronts() if own else ():
            f, b = own.symbolic.fronts[k], own.blocks[k]
            w = f.last - f.first
            every = nodes[own.symbolic.order[np.concatenate((np.arange(f.first, f.last), f.rows))]]
            if diagonal:
                r = c = np.arange(w)
            else:
                # What a front holds for its shape alone isn't in the pattern.
                r, c = np.nonzero(np.tri(len(every), w, dtype=bool) & (b != 0))
            i.append(np.maximum(every[r], every[c]))
            j.append(np.minimum(every[r], every[c]))
            z.append(block[r, c])
            held += len(r)
            if held > 500_000:
                yield made()
                i, j, z, held = [], [], [], 0
        if held:
            yield made()

    return factor.groupBy(*_keys(factor)).applyInArrow(run, schema)


def diagonal_two_ways(entries: DataFrame, probed: Column, conf: EngineConf | None = None) -> DataFrame:
    """(matrix_id, call_id, i, x, z) for diagonal entries that are probed: that of the inverse as a solve's x_i for the i-th unit
    vector, and z of the selected inverse. The factor stays in the task; a matrix or part without one gives no rows."""
    conf = conf or EngineConf()
    keys = _keys(entries)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = [x.as_py() for x in key]
        i, j, v, p = _gathered(batches, "i", "j", "v", "p")
        p = i[p == 1]
        order = np.lexsort((i, j))
        i, j, v = i[order], j[order], v[order]
        del order
        if not len(p) or _status_of(i, j, v) != "ok":
            return
        nodes, i, j = _numbered(i, j) if len(key) > 2 else (np.arange(int(i.max()) + 1), i, j)
        p = np.unique(np.searchsorted(nodes, p))
        try:
            factor = kernels.factorise(_analysis(len(nodes), i, j, conf, None), i, j, v)
        except kernels.NotPositiveDefinite:
            return
        del i, j, v
        x, z = factor.solve_at(p, p, np.ones(len(p))), np.empty(len(nodes))
        for k, block in factor.inverse_fronts():
            f = factor.symbolic.fronts[k]
            z[factor.symbolic.order[f.first : f.last]] = np.diagonal(block)[: f.last - f.first]
            factor.blocks[k] = None
        yield _batch({"matrix_id": key[0], "call_id": key[1], "i": nodes[p], "x": x, "z": z[p]}, schema)

    schema = "matrix_id string, call_id long, i long, x double, z double"
    own = with_calls(entries).withColumn("p", F.when((F.col("i") == F.col("j")) & probed, 1).otherwise(0).cast("long"))
    return own.select(*keys, "i", "j", "v", "p").groupBy(*keys).applyInArrow(run, schema)


def lookup(values: DataFrame, requested: DataFrame, value: str) -> DataFrame:
    """requested(matrix_id, call_id, i, j) with the value and in_pattern; i and j in either order. What isn't in the pattern
    is null, not zero: of an inverse it is unknown."""
    at = values.select(*KEYS, F.col("i").alias("_i"), F.col("j").alias("_j"), value, F.lit(True).alias("in_pattern"))
    asked = requested.withColumns({"_i": F.greatest("i", "j"), "_j": F.least("i", "j")})
    return asked.join(at, [*KEYS, "_i", "_j"], "left").select(*KEYS, "i", "j", value, F.coalesce("in_pattern", F.lit(False)).alias("in_pattern"))


def factor_lookup(factor: DataFrame, requested: DataFrame) -> DataFrame:
    """lookup() of the factor by original ids: both are mapped through its ordering."""
    perm = permutations(factor)
    a = perm.select("matrix_id", F.col("old_id").alias("i"), F.col("new_id").alias("_a"))
    b = perm.select("matrix_id", F.col("old_id").alias("j"), F.col("new_id").alias("_b"))
    asked = requested.join(a, ["matrix_id", "i"]).join(b, ["matrix_id", "j"])
    at = factor_entries(factor).select(*KEYS, F.col("i").alias("_i"), F.col("j").alias("_j"), "v", F.lit(True).alias("in_pattern"))
    asked = asked.withColumns({"_i": F.greatest("_a", "_b"), "_j": F.least("_a", "_b")})
    return asked.join(at, [*KEYS, "_i", "_j"], "left").select(*KEYS, "i", "j", "v", F.coalesce("in_pattern", F.lit(False)).alias("in_pattern"))


def neighbours(inverse: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(matrix_id, call_id, node) to (…, node, j, z): the stored entries of each node's row, both sides of the diagonal."""
    rows = inverse.select(*KEYS, F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("at"), "z")
    rows = rows.select(*KEYS, F.col("at.i").alias("node"), F.col("at.j").alias("j"), "z")
    return rows.join(nodes, [*KEYS, "node"]).select(*KEYS, "node", "j", "z")


def residual(entries: DataFrame, solution: DataFrame, rhs: DataFrame) -> DataFrame:
    """(matrix_id, call_id, rhs_id, residual): the largest |A x - b| over the largest |b|."""
    from .entries import expand

    both = expand(with_calls(entries).select(*KEYS, "i", "j", "v"))
    ax = both.join(solution.withColumnRenamed("i", "j"), [*KEYS, "j"]).groupBy(*KEYS, "rhs_id", "i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    diff = rhs.join(ax, [*KEYS, "rhs_id", "i"], "left").withColumn("d", F.abs(F.coalesce("y", F.lit(0.0)) - F.col("b")))
    return diff.groupBy(*KEYS, "rhs_id").agg((F.max("d") / F.max(F.abs("b"))).alias("residual"))


def symbolic(entries: DataFrame, conf: EngineConf | None = None) -> DataFrame:
    """Per column in the order of the ids: parent (null at a root), post (place in a postorder), level, count (entries of the
    factor's column, diagonal included), supernode (its first column); the ordering is the identity."""
    widest = (conf or EngineConf()).widest_front

    def run(key, pdf):
        from ..functions import symbolic as s

        i, j = pdf["i"].to_numpy(np.int64), pdf["j"].to_numpy(np.int64)
        n = int(max(i.max(), j.max())) + 1
        starts, cols = s.lower_csr(n, i, j)
        parent = s.elimination_tree(n, starts, cols)
        counts = s.column_counts(n, starts, cols, parent)
        post = np.empty(n, np.int64)
        post[s.postorder(parent)] = np.arange(n)
        begins = s.supernodes(parent, counts, widest)
        return pd.DataFrame({"matrix_id": key[0], "node": np.arange(n), "parent": pd.array(np.where(parent < 0, 0, parent), "Int64").copy() if n else [], "root": parent < 0, "post": post, "level": s.levels(parent), "count": counts, "supernode": begins[np.searchsorted(begins, np.arange(n), side="right") - 1]})

    out = entries.select("matrix_id", "i", "j").groupBy("matrix_id").applyInPandas(run, "matrix_id string, node long, parent long, root boolean, post long, level long, count long, supernode long")
    return out.withColumn("parent", F.when(~F.col("root"), F.col("parent"))).drop("root")


def factor_pattern(entries: DataFrame) -> DataFrame:
    """(matrix_id, i, j): the pattern of the factor in the order of the ids, the diagonal included."""
    keys = [k for k in _keys(entries) if k != "call_id"]
    schema = "matrix_id string, i long, j long"

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions import symbolic as s

        i, j = _gathered(batches, "i", "j")
        nodes, i, j = _numbered(i, j) if len(key) > 1 else (np.arange(int(max(i.max(), j.max())) + 1), i, j)
        n = len(nodes)
        starts, cols = s.lower_csr(n, i, j)
        del i, j
        held, sizes, first = [], [], 0

        def made():
            return _batch({"matrix_id": key[0].as_py(), "i": nodes[np.concatenate(held)], "j": np.repeat(nodes[first : first + len(sizes)], sizes)}, schema)

        for k, below in enumerate(s.fill_columns(n, starts, cols, s.elimination_tree(n, starts, cols))):
            held += [np.array([k]), below]
            sizes.append(len(below) + 1)
            if k % 64 == 63 and sum(sizes) > 200_000 or sizes[-1] > 100_000:
                yield made()
                held, sizes, first = [], [], k + 1
        if sizes:
            yield made()

    return entries.select(*keys, "i", "j").groupBy(*keys).applyInArrow(run, schema)


def orderings(entries: DataFrame, names: list[str]) -> DataFrame:
    """(matrix_id, ordering, old_id, new_id, nnz_l) for each named ordering: the candidates of the choice, for comparison. Of
    entries with parts (part, first) also the part, of which nnz_l is; parts follow each other."""
    extra = [c for c in ("part", "first") if c in entries.columns]
    schema = "matrix_id string, ordering string, old_id long, new_id long, nnz_l long" + (", part long" if extra else "")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions import orderings as o

        matrix, name, *part = [x.as_py() for x in key]
        i, j = _gathered(batches, "i", "j")
        nodes, i, j = _numbered(i, j) if part else (np.arange(int(max(i.max(), j.max())) + 1), i, j)
        g = o.Graph(len(nodes), i, j)
        del i, j
        order = o.ORDERINGS[name](g)
        nnz = int(kernels.tree_under(g, order)[1].sum())
        for k in range(0, len(order), 100_000):
            own = order[k : k + 100_000]
            row = {"matrix_id": matrix, "ordering": name, "old_id": nodes[own], "new_id": np.arange(k, k + len(own)) + (part[1] if part else 0), "nnz_l": nnz}
            yield _batch(row | ({"part": part[0]} if part else {}), schema)

    named = entries.select("matrix_id", *extra, "i", "j").withColumn("ordering", F.explode(F.array(*[F.lit(x) for x in names])))
    return named.groupBy("matrix_id", "ordering", *extra).applyInArrow(run, schema)


def parallel_exec(spark, tasks: int, fn, schema: str) -> DataFrame:
    """fn(rank, tasks) in each of so many tasks; it returns a list of tuples of the schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for rank in pdf["id"]:
                yield pd.DataFrame(fn(int(rank), tasks), columns=names)

    return spark.range(0, tasks, 1, tasks).mapInPandas(run, schema)
