"""Matrix files: Matrix Market coordinate text and a binary compressed-column format, both ways.

Everything goes through Spark's own readers and writers, so paths may be of any store that Spark knows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """entries of all files under path; matrix_id is the file's name without its ending. Lines of % are comments, the first
    other line of a file has its dimensions, the rest are row, column and value, counted from 1. Entries above the
    diagonal are swapped below it. A file that isn't square raises an error when it is read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    folder = F.regexp_extract("path", r"matrix_id=([^/]+)/[^/]*$", 1)
    name = F.when(F.length(folder) > 0, folder).otherwise(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))
    full = lines.where(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0))
    # Lines of one file are numbered in their order, over all of its splits.
    pos = full.select(name.alias("matrix_id"), F.split(F.trim("value"), r"\s+").alias("p"), F.struct("start", F.monotonically_increasing_id()).alias("k"))
    first = pos.groupBy("matrix_id").agg(F.min("k").alias("k0"), F.min_by("p", "k").alias("d"))
    checked = pos.join(first, "matrix_id").where("k > k0")
    square = F.when(F.col("d")[0] != F.col("d")[1], F.raise_error(F.concat(F.lit("not square: "), "matrix_id"))).otherwise(F.col("p"))
    rows = checked.select("matrix_id", square.alias("p"))
    a, b = F.col("p")[0].cast("long") - 1, F.col("p")[1].cast("long") - 1
    return rows.select("matrix_id", F.greatest(a, b).alias("i"), F.least(a, b).alias("j"), F.when(F.size("p") > 2, F.col("p")[2].cast("double")).otherwise(1.0).alias("v"))


def write_matrix_market(entries: DataFrame, path: str) -> None:
    """One file for each matrix, under path/matrix_id=…: a header, dimensions, then the entries by column and row."""
    size = entries.groupBy("matrix_id").agg((F.max("i") + 1).alias("n"), F.count("*").alias("nnz"))
    head = size.select("matrix_id", F.lit(0).alias("o"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit("%%MatrixMarket matrix coordinate real symmetric").alias("value"))
    dims = size.select("matrix_id", F.lit(1).alias("o"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.concat_ws(" ", F.col("n").cast("string"), F.col("n").cast("string"), F.col("nnz").cast("string")).alias("value"))
    body = entries.select("matrix_id", F.lit(2).alias("o"), "i", "j", F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string")).alias("value"))
    rows = head.union(dims).union(body).repartition("matrix_id").sortWithinPartitions("matrix_id", "o", "j", "i")
    rows.select("matrix_id", "value").write.partitionBy("matrix_id").text(path)


def to_binary(entries: DataFrame) -> DataFrame:
    """(matrix_id, content): n and nnz as two 32-bit numbers, nnz row numbers from 1 and n + 1 column starts as 32-bit numbers,
    then nnz doubles, by column and row; little-endian."""

    def run(key, pdf):
        pdf = pdf.sort_values(["j", "i"])
        n = int(pdf["i"].max()) + 1
        starts = np.concatenate(([0], np.cumsum(np.bincount(pdf["j"], minlength=n))))
        content = b"".join(x.tobytes() for x in (np.array([n, len(pdf)], "<i4"), pdf["i"].to_numpy().astype("<i4") + np.int32(1), starts.astype("<i4"), pdf["v"].to_numpy().astype("<f8")))
        return pd.DataFrame({"matrix_id": [key[0]], "content": [content]})

    return entries.select("matrix_id", "i", "j", "v").groupBy("matrix_id").applyInPandas(run, "matrix_id string, content binary")


def from_binary(files: DataFrame) -> DataFrame:
    """(matrix_id, content), as of to_binary() or of spark.read.format("binaryFile"), to entries. The header may also be two doubles."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["matrix_id"], pdf["content"], strict=True):
                n, nnz = np.frombuffer(content, "<i4", 2).tolist()
                at = 8
                if len(content) != at + 4 * nnz + 4 * (n + 1) + 8 * nnz:
                    n, nnz = map(int, np.frombuffer(content, "<f8", 2))
                    at = 16
                    if len(content) != at + 4 * nnz + 4 * (n + 1) + 8 * nnz:
                        raise ValueError(f"{name}: not of this format")
                rows = np.frombuffer(content, "<i4", nnz, at).astype(np.int64) - 1
                starts = np.frombuffer(content, "<i4", n + 1, at + 4 * nnz)
                values = np.frombuffer(content, "<f8", nnz, at + 4 * nnz + 4 * (n + 1))
                cols = np.repeat(np.arange(n), np.diff(starts))
                yield pd.DataFrame({"matrix_id": name, "i": np.maximum(rows, cols), "j": np.minimum(rows, cols), "v": values})

    return files.select("matrix_id", "content").mapInPandas(run, "matrix_id string, i long, j long, v double")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return from_binary(files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("matrix_id"), "content"))
