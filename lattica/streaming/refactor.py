"""New values of known patterns from a stream: each micro-batch is factored anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..operators import numeric
from ..operators.entries import fill_values


def stream_logdets(values: DataFrame, pattern: DataFrame, sink: str, checkpoint: str, conf: EngineConf | None = None):
    """values: a stream of (matrix_id, call_id, pos, v); pattern(matrix_id, pos, i, j), i >= j, each place once. A call's values come
    whole in one micro-batch. Appends (batch_id, matrix_id, call_id, n, nnz_l, logdet, ordering, status) to the Parquet
    folder sink. A batch that runs again after a failure replaces what it wrote before. Returns the started query."""

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = numeric.logdet(fill_values(pattern, df).select("matrix_id", "call_id", "i", "j", "v"), conf)
        rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return values.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
