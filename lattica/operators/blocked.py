"""One large matrix over the whole cluster: a factorisation by square tiles, level by level of the tiles' elimination tree.

Tiles are rows (ti, tj, h, w, block). The quotient graph of the tiles is analysed on the driver: it has one row for each non-zero tile,
a bound that grows with the square of n / tile_size at most and is checked. Tile columns of one level don't depend on each other
and are factored at once; what they add to later tiles is summed up by a shuffle. Each level is written to the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..functions import orderings, symbolic
from ..functions.kernels import solve_lower
from ..workspace import stage

TILE = "ti long, tj long, h int, w int, block array<double>"
MOST_TILES = 4_000_000


def _tiled(entries: DataFrame, n: int, size: int, place: np.ndarray) -> DataFrame:
    """Lower tiles of entries(i, j, v) with tiles renumbered by place; diagonal tiles are full and symmetric."""
    spark = entries.sparkSession
    places = spark.createDataFrame(pd.DataFrame({"t": np.arange(len(place)), "p": place}), "t long, p long")
    at = entries.select(F.expr(f"i div {size}").alias("a"), F.expr(f"j div {size}").alias("b"), (F.col("i") % size).alias("r"), (F.col("j") % size).alias("c"), "v")
    at = at.join(places.select(F.col("t").alias("a"), F.col("p").alias("pa")), "a").join(places.select(F.col("t").alias("b"), F.col("p").alias("pb")), "b")
    low = F.col("pa") >= F.col("pb")
    at = at.select(F.greatest("pa", "pb").alias("ti"), F.least("pa", "pb").alias("tj"), F.when(low, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("b"), F.when(low, F.col("r")).otherwise(F.col("c")).alias("r"), F.when(low, F.col("c")).otherwise(F.col("r")).alias("c"), "v")

    def build(key, pdf):
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        h, w = min(size, n - a * size), min(size, n - b * size)
        m = np.zeros((h, w))
        m[pdf["r"], pdf["c"]] = pdf["v"]
        if key[0] == key[1]:
            m[pdf["c"], pdf["r"]] = pdf["v"]
        return pd.DataFrame({"ti": [key[0]], "tj": [key[1]], "h": [h], "w": [w], "block": [m.ravel()]})

    return at.groupBy("ti", "tj").applyInPandas(build, TILE)


def _block(row) -> np.ndarray:
    return np.asarray(row.block, float).reshape(row.h, row.w)


def _factored(pdf: pd.DataFrame) -> pd.DataFrame:
    """One tile column: its diagonal tile's factor, and the tiles below times its inverse transposed."""
    tj = int(pdf["tj"].iloc[0])
    rows = {int(r.ti): r for r in pdf.itertuples()}
    try:
        l = np.linalg.cholesky(_block(rows[tj]))
    except np.linalg.LinAlgError:
        l = np.full((rows[tj].h, rows[tj].w), np.nan)
    out = []
    for ti, r in sorted(rows.items()):
        m = l if ti == tj else solve_lower(l, np.ascontiguousarray(_block(r).T)).T if np.isfinite(l).all() else np.full((r.h, r.w), np.nan)
        out.append((ti, tj, r.h, r.w, m.ravel()))
    return pd.DataFrame(out, columns=["ti", "tj", "h", "w", "block"])


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    """The products of one finished tile column, as subtractions from later tiles."""
    rows = sorted((int(r.ti), _block(r)) for r in pdf.itertuples() if r.ti != r.tj)
    out = [(a, b, x.shape[0], y.shape[0], (-(x @ y.T)).ravel()) for i, (a, x) in enumerate(rows) for b, y in rows[: i + 1]]
    return pd.DataFrame(out, columns=["ti", "tj", "h", "w", "block"])


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum(np.sort(np.stack(pdf["block"].to_numpy()), axis=0), axis=0) if len(pdf) > 2 else np.sum(np.stack(pdf["block"].to_numpy()), axis=0)
    return pdf.iloc[[0]][["ti", "tj", "h", "w"]].assign(block=[total])


def blocked_cholesky(entries: DataFrame, n: int, conf: EngineConf | None = None) -> tuple[DataFrame, np.ndarray]:
    """(tiles of the factor, place of each tile in the factor's order) of one matrix of entries(i, j, v), i >= j, each place once.

    A pivot that isn't positive gives a factor of NaN from there on; blocked_logdet() then is null.
    """
    conf = conf or EngineConf()
    size = conf.tile_size
    count = math.ceil(n / size)
    own = entries.select(F.expr(f"i div {size}").alias("a"), F.expr(f"j div {size}").alias("b")).distinct()
    if own.limit(MOST_TILES + 1).count() > MOST_TILES:
        raise ValueError("more tiles than the driver may hold: use larger ones")
    pattern = own.toPandas()
    i, j = pattern["a"].to_numpy(np.int64), pattern["b"].to_numpy(np.int64)
    order = orderings.ORDERINGS[conf.tile_ordering](orderings.Graph(count, i, j))
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    starts, cols = symbolic.lower_csr(count, place[i], place[j])
    level = symbolic.levels(symbolic.elimination_tree(count, starts, cols))
    spark = entries.sparkSession
    levels = spark.createDataFrame(pd.DataFrame({"tj": np.arange(count), "level": level}), "tj long, level long")
    open_, done = stage(_tiled(entries, n, size, place), "tiles"), []
    for k in range(int(level.max()) + 1 if count else 0):
        now = levels.where(F.col("level") == k).select("tj")
        factored = stage(open_.join(F.broadcast(now), "tj").select("ti", "tj", "h", "w", "block").groupBy("tj").applyInPandas(_factored, TILE), "factored")
        done.append(factored)
        if k == int(level.max()):
            break
        rest = open_.join(F.broadcast(now), "tj", "left_anti").select("ti", "tj", "h", "w", "block")
        added = factored.groupBy("tj").applyInPandas(_added, TILE)
        open_ = rest.union(added).groupBy("ti", "tj").applyInPandas(_summed, TILE)
        open_ = stage(open_, "tiles") if (k + 1) % conf.checkpoint_every == 0 else open_
    out = done[0] if done else open_
    for d in done[1:]:
        out = out.union(d)
    return out, place


def blocked_logdet(factor: DataFrame) -> DataFrame:
    """(logdet): twice the sum of the logarithms of the factor's diagonal; null if a pivot wasn't positive."""

    def run(batches):
        for pdf in batches:
            logs = [float(np.log(np.diagonal(_block(r))).sum()) for r in pdf.itertuples()]
            fine = [bool(np.isfinite(x)) for x in logs]
            yield pd.DataFrame({"s": [x if y else 0.0 for x, y in zip(logs, fine, strict=True)], "fine": fine})

    sums = factor.where("ti = tj").mapInPandas(run, "s double, fine boolean").agg(F.sum("s").alias("s"), F.min("fine").alias("fine"))
    return sums.select(F.when(F.col("fine"), 2 * F.col("s")).alias("logdet"))
