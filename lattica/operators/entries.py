"""Relational operators on matrices as tables: entries(matrix_id, i, j, v), i >= j, counted from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "matrix_id"


def normalise(raw: DataFrame) -> DataFrame:
    """Entries of the upper triangle are swapped into the lower one; other columns are kept."""
    return raw.withColumns({"i": F.greatest("i", "j"), "j": F.least("i", "j")})


def dedupe_last(raw: DataFrame) -> DataFrame:
    """Of raw(matrix_id, pos, i, j, v) the value of the largest pos for each place."""
    return normalise(raw).groupBy(KEY, "i", "j").agg(F.max_by("v", "pos").alias("v"))


def invalid(raw: DataFrame, sizes: DataFrame) -> DataFrame:
    """The entries that can't be part of their matrix, with the reason; sizes(matrix_id, n)."""
    reason = F.when(F.col("i").isNull() | F.col("j").isNull(), "null_index").when((F.least("i", "j") < 0) | (F.greatest("i", "j") >= F.col("n")), "out_of_range").when(F.col("v").isNull() | F.isnan("v"), "no_value")
    return raw.join(sizes, KEY).withColumn("reason", reason).where("reason IS NOT NULL").drop("n")


def fill_values(pattern: DataFrame, values: DataFrame) -> DataFrame:
    """pattern(matrix_id, pos, i, j) with values(matrix_id, call_id, pos, v) of each call; places without a value are 0."""
    calls = values.select(KEY, "call_id").distinct()
    return pattern.join(calls, KEY).join(values, [KEY, "call_id", "pos"], "left").select(KEY, "call_id", "pos", "i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def expand(entries: DataFrame) -> DataFrame:
    """Both triangles: every entry off the diagonal also the other way round, by one pass without a union."""
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    rest = [c for c in entries.columns if c not in ("i", "j")]
    return entries.select(*rest, F.explode(both).alias("_at")).select(*rest, "_at.i", "_at.j").select(*entries.columns)


def matvec(entries: DataFrame, x: DataFrame) -> DataFrame:
    """x(matrix_id, i, x) to (matrix_id, i, y): y = A x; rows without entries are left out."""
    return expand(entries).join(x.withColumnRenamed("i", "j"), [KEY, "j"]).groupBy(KEY, "i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def quadratic_form(entries: DataFrame, x: DataFrame) -> DataFrame:
    """(matrix_id, q): q = x' A x; one pass over the triangle."""
    a = x.select(KEY, "i", F.col("x").alias("xi"))
    b = x.select(KEY, F.col("i").alias("j"), F.col("x").alias("xj"))
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    return entries.join(a, [KEY, "i"]).join(b, [KEY, "j"]).groupBy(KEY).agg(F.sum(F.col("v") * F.col("xi") * F.col("xj") * twice).alias("q"))


def degree(entries: DataFrame) -> DataFrame:
    """(matrix_id, i, degree): neighbours of each node that has any, without itself."""
    return expand(entries.where("i <> j").select(KEY, "i", "j").distinct()).groupBy(KEY, "i").agg(F.count("*").alias("degree"))


def graph_statistics(entries: DataFrame) -> DataFrame:
    """Per matrix: n, nnz (of the triangle), mean_degree, max_degree, bandwidth."""
    size = entries.groupBy(KEY).agg((F.max("i") + 1).alias("n"), F.count("*").alias("nnz"), F.max(F.col("i") - F.col("j")).alias("bandwidth"))
    own = degree(entries).groupBy(KEY).agg(F.sum("degree").alias("total"), F.max("degree").alias("most"))
    return size.join(own, KEY, "left").select(KEY, "n", "nnz", (F.coalesce("total", F.lit(0)) / F.col("n")).alias("mean_degree"), F.coalesce("most", F.lit(0)).alias("max_degree"), "bandwidth")


def dense_nodes(entries: DataFrame, factor: float = 6.0) -> DataFrame:
    """(matrix_id, i, degree) of the nodes of over factor times their matrix's mean degree."""
    mean = graph_statistics(entries).select(KEY, "mean_degree")
    return degree(entries).join(mean, KEY).where(F.col("degree") > F.greatest(F.col("mean_degree"), F.lit(1.0)) * factor).select(KEY, "i", "degree")


# -- permutations: perm(matrix_id, old_id, new_id) -----------------------------------------------------------------------


def perm_apply(entries: DataFrame, perm: DataFrame) -> DataFrame:
    """The entries of the permuted matrix, in its lower triangle."""
    a = perm.select(KEY, F.col("old_id").alias("i"), F.col("new_id").alias("_a"))
    b = perm.select(KEY, F.col("old_id").alias("j"), F.col("new_id").alias("_b"))
    return normalise(entries.join(a, [KEY, "i"]).join(b, [KEY, "j"]).withColumns({"i": F.col("_a"), "j": F.col("_b")})).select(*entries.columns)


def perm_invert(perm: DataFrame) -> DataFrame:
    return perm.select(KEY, F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id"))


def perm_compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """Apply first, then second."""
    then = second.select(KEY, F.col("old_id").alias("_m"), F.col("new_id").alias("_n"))
    return first.withColumnRenamed("new_id", "_m").join(then, [KEY, "_m"]).select(KEY, "old_id", F.col("_n").alias("new_id"))


def perm_logical(perm: DataFrame) -> DataFrame:
    """A permutation with gaps, as after dropping padding, to ranks from 0."""
    return perm.select(KEY, "old_id", (F.row_number().over(Window.partitionBy(KEY).orderBy("new_id")) - 1).cast("long").alias("new_id"))


def perm_check(perm: DataFrame) -> DataFrame:
    """(matrix_id, n, valid): whether it maps 0 to n - 1 onto themselves."""
    own = perm.groupBy(KEY).agg(F.count("*").alias("n"), F.countDistinct("old_id").alias("olds"), F.countDistinct("new_id").alias("news"), F.least(F.min("old_id"), F.min("new_id")).alias("low"), F.greatest(F.max("old_id"), F.max("new_id")).alias("high"))
    return own.select(KEY, "n", ((F.col("olds") == F.col("n")) & (F.col("news") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("valid"))


# -- tiles ---------------------------------------------------------------------------------------------------------------


def _tile(x: str, size: int) -> F.Column:
    return F.expr(f"{x} div {int(size)}")


def tiles(entries: DataFrame, size: int) -> DataFrame:
    """(matrix_id, ti, tj, nnz): the tiles that hold entries; diagonal tiles are always there."""
    own = entries.select(KEY, _tile("i", size).alias("ti"), _tile("j", size).alias("tj")).groupBy(KEY, "ti", "tj").agg(F.count("*").alias("nnz"))
    every = entries.groupBy(KEY).agg(F.max("i").alias("m")).select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), _tile("m", size))).alias("ti"))
    diagonal = every.select(KEY, "ti", F.col("ti").alias("tj"))
    return own.join(diagonal, [KEY, "ti", "tj"], "full").select(KEY, "ti", "tj", F.coalesce("nnz", F.lit(0)).alias("nnz"))


def tile_statistics(entries: DataFrame, size: int) -> DataFrame:
    """Per matrix: tiles, occupancy (mean share of entries over tiles off the diagonal; null if there are none), fanout (most
    tiles off the diagonal in a tile column)."""
    n = entries.groupBy(KEY).agg((F.max("i") + 1).alias("n"))
    edge = lambda t: F.least(F.lit(size), F.col("n") - F.col(t) * size)
    own = tiles(entries, size).join(n, KEY)
    off = F.col("ti") > F.col("tj")
    share = F.when(off, F.col("nnz") / (edge("ti") * edge("tj")))
    per_column = own.groupBy(KEY, "tj").agg(F.count("*").alias("tiles"), F.sum(F.when(off, 1).otherwise(0)).alias("off"), F.sum(share).alias("share"))
    return per_column.groupBy(KEY).agg(F.sum("tiles").alias("tiles"), F.sum("share").alias("s"), F.sum("off").alias("o"), F.max("off").alias("fanout")).select(KEY, "tiles", F.when(F.col("o") > 0, F.col("s") / F.col("o")).alias("occupancy"), "fanout")


def column_skew(entries: DataFrame) -> DataFrame:
    """(matrix_id, skew): the largest column count over the mean one."""
    own = entries.groupBy(KEY, "j").agg(F.count("*").alias("c"))
    return own.groupBy(KEY).agg((F.max("c") / F.avg("c")).alias("skew"))
