"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small_join, stage

#: The weights of the sources in code point order, over and over.
WEIGHTS = (5, 2, 1)


def sized(docs: DataFrame) -> DataFrame:
    """docs with a long column size: the number of words of the text, 0 if null."""
    return docs.withColumn("size", F.coalesce(F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"))), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, size) to one row per source: source, rank, source_size, n, target.

    Sources by code point, null last, weigh weights in turn and share `share` of all sizes. A target stops at `most` times
    its source's size; what is over goes to the others by weight until none is above. That ends where each source has the
    smaller of level * weight and its stop, so the level is found from the sources in the order of stop / weight.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # One row for each source from here on.
    ranked = own.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    stop = F.col("source_size") * F.lit(most)
    w = Window.orderBy("ratio", "rank")
    level = (
        ranked.withColumns({"weight": weight, "stop": stop})
        .withColumn("ratio", F.col("stop") / F.col("weight"))
        .withColumns({
            "total": F.sum("source_size").over(Window.partitionBy()) * F.lit(share),
            "stopped": F.coalesce(F.sum("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weights": F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)),
        })
        .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("weights"))
        # The first source at which the level stays below its ratio settles the level; if none, all stop.
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(Window.partitionBy())["level"])
    )
    target = F.when(F.col("level").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("level") * F.col("weight")))
    return level.select("source", "rank", F.col("source_size").cast("long").alias("source_size"), "n", target.alias("target"))


def systematic_copies(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """docs(doc_id, source, size, ...) with source_size, target and copies (int): how often the mix takes each row.

    Each document of a source expects target / source_size copies. In the order of (size, doc_id), which spreads the draw
    over short and long documents alike, the prefix sums of these, plus one offset that the seed and the source give, cross
    an integer boundary just as often as the document is taken: by that many copies, floor or ceiling of the expectation.

    The order is by range over all tasks, so that a source is cut into as many pieces as it needs; the pieces' counts are
    summed up before them. Null sources are a source; null sizes count as 0; repeated rows are documents of their own.
    A source without words takes nothing. An empty table gives no rows. Ties in size go by doc_id, then by the rows' order as
    read. Other columns are kept, but for those named as a result, which the result replaces.
    """
    spark, results = docs.sparkSession, {"size", "source_size", "target", "copies"}
    # A row travels as one column, so that no name of its own can clash.
    others = [c for c in docs.columns if c.lower() not in results]
    held = docs.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), F.struct(*others).alias("_row"))
    targets = stage(source_targets(held.select("source", "size"), weights, share, most), "targets")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    keyed = small_join(held.withColumn("_key", key), targets.select(key.alias("_key"), F.col("rank").alias("_rank"), "source_size", "target"), ["_key"]).drop("_key")
    order = ["_rank", "size", "doc_id", "_at"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Written, so that a row's place stays what it is when an executor is lost.
    placed = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "order").withColumn("_piece", F.shiftright("_at", 33))
    pieces = placed.groupBy("_rank", "_piece").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_rank").orderBy("_piece")) - F.col("_n")
    # At most as many rows as there are pieces and sources.
    pieces = pieces.select("_rank", "_piece", (before - F.col("_first")).alias("_shift"))
    rows = small_join(placed, pieces, ["_rank", "_piece"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))
    at = F.col("_at") + F.col("_shift")
    copies = (F.floor(u + rate * (at + 1)) - F.floor(u + rate * at)).cast("int")
    return rows.select("_row.*", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of docs(doc_id, text, source, ...), each as often as it is taken; columns unchanged."""
    # A row travels as one column, so that no name of its own can clash.
    slim = sized(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))).drop("text")
    rows = systematic_copies(slim, **how).where("copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def mixing_sql(weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42, docs: str = "documents") -> str:
    """The same in DuckDB SQL: doc_id, size, source_size, target, copies."""
    cases = " ".join(f"WHEN {k} THEN {float(w)}" for k, w in enumerate(weights))
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(weights)} AS k FROM d GROUP BY source),
    w AS (SELECT *, CASE k {cases} END AS weight, source_size * {float(most)} AS stop FROM s),
    r AS (SELECT *, stop / weight AS ratio, row_number() OVER (ORDER BY stop / weight, source) AS o, sum(source_size) OVER () * {float(share)} AS total FROM w),
    l AS (SELECT *, (total - coalesce(sum(stop) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
    v AS (SELECT level FROM l WHERE level <= ratio ORDER BY o LIMIT 1),
    t AS (SELECT source, source_size, coalesce(least(stop, (SELECT level FROM v) * weight), stop)::DOUBLE AS target FROM l),
    p AS (SELECT d.doc_id, d.size, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS place,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        ('0x' || substr(md5('{seed}:' || coalesce(d.source, '')), 1, 7))::BIGINT / {float(1 << 28)} AS u
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, (floor(u + rate * place) - floor(u + rate * (place - 1)))::BIGINT AS copies FROM p"""
