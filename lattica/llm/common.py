"""What the text operators share: the shared work folder, words, and bounded chunks of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from ..workspace import shared_path as work_dir  # noqa: F401

#: A word of the contracts, as a Java or Python pattern: what stands between ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

BLANKS = r"[\x20\x09-\x0D]+"


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written once to a new folder under the shared one and read back."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(*stages: DataFrame) -> None:
    """Deletes the folders of stages from which nothing is to be read any more: what came of them is written itself."""
    for df in stages:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; stages on disk don't need them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """release(), and a full collection in each executor: its heap and buffers grow with what is garbage, and only such a
    collection gives memory back to the system, which its Python workers share."""
    release(spark)
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1
    # Without executors (a local session) the driver's collection was all. Idle executors get one task each.
    if executors > 0:
        spark.range(0, executors, 1, executors).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def kept_by_worker(key: tuple, make):
    """make(), made once in each Python worker and kept over its tasks; for things that depend on key alone."""
    import sys

    # Functions reach a worker with copies of their modules; sys is the same for all of its tasks.
    kept = sys.__dict__.setdefault("_lattica_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() splits at just the blanks that WORD leaves out."""
    return text.encode("utf-8", "replace").split() if text else []


def chunks(batches: Iterator[pa.RecordBatch], text: int, max_chars: int = 1_000_000, max_rows: int = 2000) -> Iterator[list[list]]:
    """Lists of columns of at most max_rows rows and, but for single longer texts, max_chars characters.

    Bounds the memory of a Python worker whatever the lengths of the texts in an Arrow batch. At the end of a task
    what it has freed goes back to the system: an idle worker shares its executor's memory with later stages.
    """
    try:
        yield from _chunks(batches, text, max_chars, max_rows)
    finally:
        trim()


def trim() -> None:
    """Returns freed memory to the system, where the C library can (glibc)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _chunks(batches, text: int, max_chars: int, max_rows: int):
    for batch in batches:
        column = batch.column(text)
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        begin, total = 0, 0
        for i, n in enumerate(sizes):
            if i > begin and (total + n > max_chars or i - begin >= max_rows):
                yield [c.to_pylist() for c in batch.slice(begin, i - begin).columns]
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield [c.to_pylist() for c in batch.slice(begin).columns]


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = 50_000, max_bytes: int = 64_000_000) -> DataFrame:
    """Joins a side whose size was checked: broadcast up to max_rows rows and max_bytes bytes, an ordinary join beyond."""
    fixed = sum(8 for f in small.schema if not isinstance(f.dataType, StringType))
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in small.schema if isinstance(f.dataType, StringType)]
    if any(isinstance(f.dataType, (ArrayType, MapType, StructType, BinaryType)) for f in small.schema):
        raise TypeError("only columns of numbers and strings are broadcast")
    size = sum(texts, F.lit(fixed))
    n, size = small.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    return big.join(F.broadcast(small) if n <= max_rows and (size or 0) <= max_bytes else small, on, how)
