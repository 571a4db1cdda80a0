"""Matrices derived from ordinary tables: positive definite by construction (a graph Laplacian or a Gram matrix, plus one)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chains(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """A path through the rows of each key, in order: Laplacian plus identity, as entries. Null keys are left out."""
    w = Window.partitionBy("matrix_id").orderBy(*order)
    nodes = rows.where(F.col(key).isNotNull()).withColumn("matrix_id", F.col(key).cast("string"))
    nodes = nodes.select("matrix_id", *order).withColumns({"i": (F.row_number().over(w) - 1).cast("long"), "next": F.lead(F.lit(1)).over(w)})
    links = F.when(F.col("i") > 0, 1.0).otherwise(0.0) + F.when(F.col("next").isNotNull(), 1.0).otherwise(0.0)
    diagonal = F.struct(F.col("i").alias("j"), (links + 1.0).alias("v"))
    before = F.struct((F.col("i") - 1).alias("j"), F.lit(-1.0).alias("v"))
    at = F.when(F.col("i") > 0, F.array(diagonal, before)).otherwise(F.array(diagonal))
    return nodes.select("matrix_id", "i", F.explode(at).alias("at")).select("matrix_id", "i", "at.*")


def bipartite(left: DataFrame, left_id: str, right: DataFrame, right_id: str, links: DataFrame, link_left: str, link_right: str, name: str) -> DataFrame:
    """Left nodes, then right ones, by ascending id; an edge weighs the number of its links. Weighted Laplacian plus identity."""
    size = left.count()

    def numbered(df, col, base):
        # Nodes are dimension rows; their order is by range over all tasks.
        own = df.select(F.col(col).alias("id")).where("id IS NOT NULL").distinct()
        parts = own.repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id())
        piece = F.shiftright("at", 33)
        counts = parts.groupBy(piece.alias("piece")).agg(F.count("*").alias("c"), F.min("at").alias("first"))
        before = counts.select("piece", (F.sum("c").over(Window.orderBy("piece")) - F.col("c") - F.col("first")).alias("shift"))
        return parts.join(before, piece == before.piece).select("id", (F.col("at") + F.col("shift") + base).alias("node"))

    a, b = numbered(left, left_id, 0), numbered(right, right_id, size)
    weights = links.groupBy(F.col(link_left).alias("l"), F.col(link_right).alias("r")).agg(F.count("*").cast("double").alias("w"))
    edges = weights.join(a.select(F.col("id").alias("l"), F.col("node").alias("j")), "l").join(b.select(F.col("id").alias("r"), F.col("node").alias("i")), "r").select("i", "j", "w")
    off = edges.select("i", "j", (-F.col("w")).alias("v"))
    sums = edges.select(F.explode(F.array("i", "j")).alias("i"), "w").groupBy("i").agg(F.sum("w").alias("s"))
    diagonal = a.union(b).select(F.col("node").alias("i")).join(sums, "i", "left").select("i", F.col("i").alias("j"), (F.coalesce("s", F.lit(0.0)) + 1.0).alias("v"))
    return off.union(diagonal).select(F.lit(name).alias("matrix_id"), "i", "j", "v")


def gram(vectors: DataFrame, column: str, name: str) -> DataFrame:
    """X'X plus identity over the rows' vectors, which are of one length: each task adds up its rows, then the sums are added."""

    def partial(batches):
        total = None
        for pdf in batches:
            x = [v for v in pdf["x"] if v is not None]
            if x:
                m = np.stack(x).astype(float)
                total = m.T @ m + (0 if total is None else total)
        if total is not None:
            i, j = np.tril_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    sums = vectors.select(F.col(column).alias("x")).mapInPandas(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return sums.select(F.lit(name).alias("matrix_id"), "i", "j", (F.col("v") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("v"))
