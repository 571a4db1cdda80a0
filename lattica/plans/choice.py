"""Choices between jobs: the layout of a matrix, and estimates of what it needs. Thresholds are settings of this engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..operators.entries import graph_statistics

DENSE_FROM = 0.5


def layouts(entries: DataFrame, conf: EngineConf | None = None) -> DataFrame:
    """Per matrix: n, nnz, density of the triangle and layout: dense (one block), fronts (one task) or blocked (the cluster)."""
    conf = conf or EngineConf()
    own = graph_statistics(entries)
    density = F.col("nnz") / (F.col("n") * (F.col("n") + 1) / 2)
    layout = F.when(F.col("n") >= conf.blocked_from, "blocked").when((F.col("n") <= conf.dense_below) | (density >= DENSE_FROM), "dense").otherwise("fronts")
    return own.select("matrix_id", "n", "nnz", density.alias("density"), layout.alias("layout"))


def memory_bytes(n: Column, nnz_l: Column, widest: int = 128, inverse: bool = False) -> Column:
    """Bytes that factoring takes: the factor (doubled by an inverse) with row numbers of 8 bytes for every 8 values, the largest
    front's square, and three numbers for each unknown."""
    copies = 2 if inverse else 1
    return nnz_l * 9 * copies + F.least(n, F.lit(8 * widest)) * F.least(n, F.lit(8 * widest)) * 8 + n * 24


def memory_report(summary: DataFrame, available: float, widest: int = 128, inverse: bool = False) -> DataFrame:
    """summary(…, n, nnz_l, …) with bytes, factor_bytes, and fits: whether 90 % of the available bytes are enough."""
    size = memory_bytes(F.col("n"), F.col("nnz_l"), widest, inverse)
    return summary.withColumns({"factor_bytes": F.col("nnz_l") * 9, "bytes": size, "fits": size <= F.lit(0.9 * available)})
