"""A session: matrices of a set of groups, their factors and what is asked of them, each computed once and kept on disk."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .conf import EngineConf
from .operators import entries as e
from .operators import numeric
from .plans import choice
from .workspace import stage


class SpdSession:
    """Groups are matrix_ids, calls their numeric instances. Tables are immutable: new values make new factors."""

    def __init__(self, spark: SparkSession, conf: EngineConf | None = None):
        self.spark, self.conf = spark, conf or EngineConf()
        spark.sparkContext.setLogLevel(self.conf.log_level)
        self._pattern = self._values = self._order = None
        self._alias: dict[tuple, tuple] = {}
        self._factor = self._inverse = None
        self.timings: dict[str, float] = {}

    @staticmethod
    def version() -> str:
        return __version__

    # -- sources

    def assign_pattern(self, raw: DataFrame) -> SpdSession:
        """raw(matrix_id, pos, i, j): one pattern for all calls of a group; of places that repeat the last pos counts."""
        self._pattern, self._factor, self._inverse = e.normalise(raw.select("matrix_id", "pos", "i", "j")), None, None
        return self

    def assign_values(self, values: DataFrame) -> SpdSession:
        """values(matrix_id, call_id, pos, v); places of the pattern without a value are 0. Drops factors of former values."""
        self._values, self._factor, self._inverse = values, None, None
        return self

    def assign_order(self, order: DataFrame | None) -> SpdSession:
        """order(matrix_id, old_id, new_id) fixes the orderings; None lets the engine choose again."""
        if order is not None and not e.perm_check(order).where(~F.col("valid")).isEmpty():
            raise ValueError("an order isn't a permutation")
        self._order, self._factor, self._inverse = order, None, None
        return self

    def alias_call(self, matrix_id: str, call_id: int, to_matrix: str, to_call: int) -> SpdSession:
        """Answers for one call are those of another."""
        self._alias[(matrix_id, call_id)] = (to_matrix, to_call)
        return self

    def entries(self) -> DataFrame:
        if self._pattern is None:
            raise RuntimeError("assign a pattern first")
        values = self._values if self._values is not None else self._pattern.select("matrix_id", F.lit(0).cast("long").alias("call_id"), "pos", F.lit(1.0).alias("v"))
        full = e.fill_values(self._pattern, values)
        return full.groupBy("matrix_id", "call_id", "i", "j").agg(F.max_by("v", "pos").alias("v"))

    # -- work

    def _timed(self, name: str, make) -> DataFrame:
        began = time.time()
        out = stage(make(), name)
        self.timings[name] = time.time() - began
        return out

    def analyse(self) -> DataFrame:
        """Ordering and pattern sizes alone: matrix_id, call_id, n, nnz_l, ordering, status."""
        return numeric.summary(numeric.cholesky(self.entries(), self.conf.with_(symbolic_only=True), self._order)).drop("logdet")

    def factor(self) -> DataFrame:
        if self._factor is None:
            self._factor = self._timed("factor", lambda: numeric.cholesky(self.entries(), self.conf, self._order))
        return self._factor

    def inverse(self) -> DataFrame:
        if self._inverse is None:
            self._inverse = self._timed("inverse", lambda: numeric.selected_inverse(self.factor()))
        return self._inverse

    def clear_inverse(self) -> None:
        self._inverse = None

    def close(self) -> None:
        self._factor = self._inverse = self._pattern = self._values = self._order = None

    # -- answers

    def _aliased(self, answers: DataFrame) -> DataFrame:
        out = answers
        for (m, c), (tm, tc) in self._alias.items():
            own = answers.where((F.col("matrix_id") == tm) & (F.col("call_id") == tc)).withColumns({"matrix_id": F.lit(m), "call_id": F.lit(c).cast("long")})
            out = out.where(~((F.col("matrix_id") == m) & (F.col("call_id") == c))).unionByName(own)
        return out

    def summary(self) -> DataFrame:
        return self._aliased(numeric.summary(self.factor()))

    def logdets(self) -> DataFrame:
        return self.summary().select("matrix_id", "call_id", "logdet", "status")

    def solve(self, rhs: DataFrame, part: str = "full") -> DataFrame:
        return numeric.solve(self.factor(), rhs, part)

    def factor_values(self) -> DataFrame:
        return numeric.factor_entries(self.factor())

    def factor_elements(self, requested: DataFrame) -> DataFrame:
        return numeric.factor_lookup(self.factor(), requested)

    def inverse_elements(self, requested: DataFrame) -> DataFrame:
        return numeric.lookup(self.inverse(), requested, "z")

    def inverse_rows(self, nodes: DataFrame) -> DataFrame:
        return numeric.neighbours(self.inverse(), nodes)

    def permutation(self) -> DataFrame:
        return numeric.permutations(self.factor())

    def inverse_permutation(self) -> DataFrame:
        return e.perm_invert(self.permutation())

    def call_counts(self) -> DataFrame:
        return self.summary().groupBy("matrix_id").agg(F.count("*").alias("calls"))

    def memory(self, available: float, inverse: bool = False) -> DataFrame:
        return choice.memory_report(self.analyse(), available, self.conf.widest_front, inverse)

    def timing_report(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.timings.items()), "step string, seconds double")
