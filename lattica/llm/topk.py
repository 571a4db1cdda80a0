"""Exact top-k by inner product over a bit-sliced index.

An index block holds, for rows in ascending id order, one bitmap for each bit of each quantised component (two's
complement: the highest slice counts negative). For a query, the scores of all rows of the block come from adding these
slices, each shifted by the set digits of the query's components, with carry-save bitmap adders. The k best rows are then
selected from the most significant score slice downward; rows that tie at the boundary are taken by ascending id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stage

#: Components saturate at this, where doubles stop telling integers apart.
MOST = 1 << 53


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): v has floor(scale * x) of each component, no further from zero than MOST. Null ids or vectors, empty vectors and
    those with null or non-finite components take no part; rows that repeat each count."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * F.lit(float(scale))))).cast("long")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, F.transform(v, whole)).alias("v"))
    return rows.where("id IS NOT NULL AND v IS NOT NULL")


def slices_of(values: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
    """For each column of values (rows x components): its bitmaps with their weights' exponents; the last counts negative."""
    out, n = [], len(values)
    pad = -n % 64
    for column in values.T:
        width = max(int(column.max()).bit_length(), int(~column.min()).bit_length() if column.min() < 0 else 0) + 1
        bits = (column[None, :] >> np.arange(width)[:, None] & 1).astype(np.uint8)
        packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little").view("<u8")
        out.append([(b, packed[b]) for b in range(width)])
    return out


def signed_digits(q: int) -> list[tuple[int, int]]:
    """(exponent, sign) of the non-adjacent form of q: no two neighbouring digits are set."""
    out, e = [], 0
    while q:
        if q & 1:
            d = 2 - (q & 3)
            out.append((e, d))
            q -= d
        q >>= 1
        e += 1
    return out


def score_slices(slices: list[list[tuple[int, np.ndarray]]], query: list[int], words: int) -> tuple[list[np.ndarray], int]:
    """(bitmaps of score + offset from the least significant up, offset): scores plus offset are not negative.

    A slice that counts -2^e enters as its complement: -b = (1 - b) - 1, so each adds 2^e to the offset.
    """
    columns: dict[int, list[np.ndarray]] = {}
    offset, inverted = 0, {}
    for dim, q in zip(slices, query, strict=True):
        for e, sign in signed_digits(q):
            for k, (b, bitmap) in enumerate(dim):
                negative = (sign < 0) != (k == len(dim) - 1)
                if negative:
                    offset += 1 << (b + e)
                    key = id(bitmap)
                    if key not in inverted:
                        inverted[key] = ~bitmap
                    bitmap = inverted[key]
                columns.setdefault(b + e, []).append(bitmap)
    out, e = [], 0
    while columns:
        own = columns.pop(e, [])
        at = 0
        up = columns.setdefault(e + 1, []) if len(own) > 1 else None
        while len(own) - at > 2:
            a, b, c = own[at : at + 3]
            at += 3
            x = a ^ b
            own.append(x ^ c)
            up.append((a & b) | (x & c))
        if len(own) - at == 2:
            a, b = own[at:]
            up.append(a & b)
            own.append(a ^ b)
            at += 2
        out.append(own[at] if len(own) > at else np.zeros(words, "<u8"))
        e += 1
    return out, offset


def select_top(scores: list[np.ndarray], live: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of the live rows (all, if fewer), from the most significant slice down; ties go to
    smaller positions."""
    sure, maybe = np.zeros_like(live), live
    count = lambda x: int(np.bitwise_count(x).sum())
    have, open_ = 0, count(live)
    for bitmap in reversed(scores):
        if have + open_ <= k:
            break
        ones = maybe & bitmap
        n = count(ones)
        if have + n > k:
            maybe, open_ = ones, n
        else:
            sure, have = sure | ones, have + n
            maybe, open_ = maybe & ~bitmap, open_ - n
            if have == k:
                break
    first = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    if have < k:
        ties = np.flatnonzero(np.unpackbits(maybe.view(np.uint8), bitorder="little"))
        first = np.concatenate((first, ties[: k - have]))
    return first


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, block_rows: int = 65_536, least_rows: int = 32_768, block_queries: int = 64, most_numbers: int = 1 << 22) -> DataFrame:
    """Queries: rows whose id is divisible by every; candidates: all rows but the query's own. Returns query_id, rank, id, score.

    Per query row, the k highest integer inner products (all, if fewer), ties to the smaller id. Rows that repeat an id, or id
    and vector, are rows like any others: each is a candidate, and a query of its own if its id is divisible. Vectors of another
    length than the query's aren't compared with it. Scores are exact when compared; one beyond the range of a long is
    returned as the end of that range. An empty table gives no rows. Other columns are not read.

    Queries meet candidates block by block. Blocks are dealt by the rows' numbers and bounded in rows, whatever the ids: block_rows
    candidates, fewer (down to least_rows) where a small table would leave tasks idle, and at most most_numbers components. A
    block of candidates is written as its slices and reaches a task once, not with each block of queries. Each pair of blocks yields
    at most k rows for each query, and these are ranked.
    """
    spark = vectors.sparkSession
    rows = stage(quantise(vectors, id_col, vector_col, scale).withColumn("u", F.monotonically_increasing_id()), "quantised")
    total, widest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    block_rows = min(block_rows, max(least_rows, math.ceil(total / int(spark.conf.get("spark.sql.shuffle.partitions")))), max(1, most_numbers // (widest or 1)))

    def packed(df: DataFrame, size: int, body) -> DataFrame:
        blocks = max(1, math.ceil(df.count() / size))

        def pack(pdf):
            import pandas as pd

            pdf = pdf.sort_values(["id", "u"])
            out = []
            for d, own in pdf.groupby(pdf["v"].str.len(), sort=True):
                widths, data = body(np.stack(own["v"].to_numpy()).astype("<i8", copy=False))
                out.append((int(d), len(own), own["id"].to_numpy("<i8").tobytes(), own["u"].to_numpy("<i8").tobytes(), widths, data))
            return pd.DataFrame(out, columns=["d", "n", "ids", "us", "widths", "data"])

        schema = "d int, n int, ids binary, us binary, widths binary, data binary"
        dealt = df.withColumn("_b", F.pmod(F.xxhash64("u"), F.lit(blocks)))
        return dealt.groupBy("_b").applyInPandas(lambda pdf: pack(pdf[["id", "v", "u"]]), schema).withColumn("b", F.monotonically_increasing_id())

    def index(values: np.ndarray) -> tuple[bytes, bytes]:
        slices = slices_of(values)
        return bytes(len(dim) for dim in slices), b"".join(bitmap.tobytes() for dim in slices for _, bitmap in dim)

    candidates = stage(packed(rows, block_rows, index), "slices")
    queries = stage(packed(rows.where(F.col("id") % every == 0), block_queries, lambda values: (b"", values.tobytes())), "queries")
    discard(rows)
    # Both sides are blocks now. A task gets a block of candidates once, and behind it the blocks of queries that meet it one by
    # one; where candidates alone would leave tasks idle, the queries' blocks are dealt to parts.
    blocks = candidates.count()
    parts = max(1, min(queries.count(), math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / max(1, blocks))))
    numbered = candidates.join(candidates.select("b").withColumn("place", F.row_number().over(Window.orderBy("b")) - 1), "b")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
    keyed = lambda df: df.withColumn("key", F.col("place") * parts + F.col("part"))
    columns = ["key", "d", "kind", "n", "ids", "us", "widths", "data"]
    one = keyed(numbered.withColumn("part", each(parts))).withColumn("kind", F.lit(0)).select(*columns)
    many = keyed(queries.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int")).withColumn("place", each(blocks))).withColumn("kind", F.lit(1)).select(*columns)
    meeting = one.union(many).repartition(max(1, blocks * parts), "key").sortWithinPartitions("key", "d", "kind")

    def run(batches):
        kept = None
        for batch in batches:
            at_row = {name: batch.column(k) for k, name in enumerate(columns)}
            for r in range(batch.num_rows):
                row = {name: column[r].as_py() for name, column in at_row.items()}
                ids, us = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["us"], "<i8")
                if row["kind"] == 0:
                    words, data, at, slices = -(-row["n"] // 64), np.frombuffer(row["data"], "<u8"), 0, []
                    for width in row["widths"]:
                        slices.append([(e, data[at + e * words : at + (e + 1) * words]) for e in range(width)])
                        at += width * words
                    everyone = np.packbits(np.pad(np.ones(len(ids), np.uint8), (0, 64 * words - len(ids))), bitorder="little").view("<u8")
                    kept = (row["key"], row["d"], ids, np.argsort(us), np.sort(us), slices, everyone, words)
                    continue
                if kept is None or kept[:2] != (row["key"], row["d"]):
                    continue  # the block has no vectors of this length
                _, _, of, order, numbers, slices, everyone, words = kept
                own = np.frombuffer(row["data"], "<i8").reshape(row["n"], row["d"])
                cols: list[list] = [[] for _ in range(5)]
                for q, u, vector in zip(ids.tolist(), us.tolist(), own.tolist(), strict=True):
                    live, place = everyone, int(np.searchsorted(numbers, u))
                    if place < len(numbers) and numbers[place] == u:
                        at, live = int(order[place]), everyone.copy()
                        live[at >> 6] &= ~np.uint64(1 << (at & 63))
                    scores, offset = score_slices(slices, vector, words)
                    best = select_top(scores, live, k)
                    # Sums of up to 2**20 products: whole numbers of any size, in two halves for the ranking of all blocks.
                    value = [sum(int(s[at >> 6] >> np.uint64(at & 63) & np.uint64(1)) << e for e, s in enumerate(scores)) - offset for at in best.tolist()]
                    for c, x in zip(cols, ([q] * len(best), [u] * len(best), of[best].tolist(), [x >> 64 for x in value], [(x & (1 << 64) - 1) - (1 << 63) for x in value]), strict=True):
                        c += x
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["query_id", "u", "id", "high", "low"])

    found = meeting.mapInArrow(run, "query_id long, u long, id long, high long, low long")
    w = Window.partitionBy("u").orderBy(F.desc("high"), F.desc("low"), "id")
    # The low half was moved down by 2**63: a score in the range of a long has a high half of 0 or -1 that agrees with it.
    low = F.col("low").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    score = F.when(F.col("high") == F.shiftright(low, 63), low).otherwise(F.when(F.col("high") < 0, F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1)).cast("long"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", score.alias("score"))
