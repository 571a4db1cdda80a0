"""Near-duplicate texts by 64-bit SimHash, found by fuzzy hashing with the binary Golay code.

A fingerprint is cut into three segments. Two fingerprints that differ in at most two bits agree in at least one
segment (pigeonhole), and in the following one differ in at most two bits. The perfect (23, 12) Golay code maps each
23-bit word to the codeword within three bits of it; the codewords of a word and of its 23 neighbours are one or six,
and two words at distance two have a common neighbour, so they share one of these. A key is therefore: which segment
is taken as equal, its bits, and one codeword index of the next segment.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stage, words_of
from .components import connected_components

#: Generator polynomial of the (23, 12) Golay code; widths of the three segments.
GENERATOR = 0b101011100011
WIDTHS = (22, 21, 21)


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of width words, in order; fewer words are one run."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    parts = map(slice, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, parts), repeat(seed)), np.uint64)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over the shingles of width words, repeats counted; zero for a text without words.

    A text of fewer words is one shingle. A bit is set if it is set in over half of the shingles' XXH64.
    """
    words = words_of(text.translate(_LOWER) if text else None)
    if not words:
        return 0
    hashes = shingle_hashes(words, width, seed)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for ids, texts in chunks(batches, 1):
            fps = np.array([fingerprint(t, width, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _syndromes(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for i in range(22, 10, -1):
        v ^= np.where(v >> i & 1, GENERATOR << (i - 11), 0)
    return v


def golay_decoder():
    """A function from 23-bit words (int64 array) to the 12-bit index of the codeword within three bits."""
    errors = [0] + [sum(1 << i for i in c) for w in (1, 2, 3) for c in combinations(range(23), w)]
    errors = np.array(errors, np.int64)
    table = np.zeros(2048, np.int64)
    table[_syndromes(errors)] = errors
    return lambda v: (v ^ table[_syndromes(v)]) >> 11


def golay_keys(fps: np.ndarray, decode) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key), without repeats; see the module's text."""
    fps = fps.view(np.uint64)
    segments, at = [], 0
    for w in WIDTHS:
        segments.append((fps >> np.uint64(at) & np.uint64((1 << w) - 1)).astype(np.int64))
        at += w
    flips = np.array([0] + [1 << i for i in range(23)], np.int64)
    index, keys = [], []
    for i in range(3):
        near = decode((segments[(i + 1) % 3][:, None] ^ flips[None, :]).ravel()).reshape(-1, 24)
        key = (np.int64(i) << 40) | (segments[i][:, None] << 12) | near
        key.sort(axis=1)
        first = np.ones(key.shape, bool)
        first[:, 1:] = key[:, 1:] != key[:, :-1]
        rows, _ = np.nonzero(first)
        index.append(rows)
        keys.append(key[first])
    return np.concatenate(index), np.concatenate(keys)


def near_links(fps: DataFrame, max_bits: int = 2, pair_limit: int = 24) -> DataFrame:
    """fps(fp), distinct: edges (a, b) whose components are those of the links at max_bits (0 to 2) or fewer bits.

    Buckets of up to pair_limit fingerprints are joined and verified. A larger bucket isn't expanded into pairs: two
    of its fingerprints link just if they are within one bit of a common word, so each is put to its 65 words (or, for
    fewer bits, joined through the same words and verified), and all at a word are tied to the smallest there.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")

    def run(batches):
        decode = golay_decoder()
        for batch in batches:
            got = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(got), 8192):
                part = got[i : i + 8192]
                index, keys = golay_keys(part, decode)
                yield pa.record_batch([pa.array(keys), pa.array(part[index])], ["key", "fp"])

    keys = stage(fps.select("fp").mapInArrow(run, "key long, fp long"), "golay")
    counts = keys.groupBy("key").count()
    few = keys.join(counts.where(F.col("count").between(2, pair_limit)).select("key"), "key")
    other = few.select("key", F.col("fp").alias("other"))
    pairs = few.join(other, "key").where("fp < other").where(F.bit_count(F.expr("fp ^ other")) <= max_bits).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    many = keys.join(counts.where(F.col("count") > pair_limit).select("key"), "key", "left_semi").select("fp").distinct()
    bits = [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]
    words = many.select("fp", F.explode(F.array(F.lit(0).cast("long"), *bits)).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("word"))
    # A word has itself and its 64 neighbours at most: these lists are short.
    stars = words.groupBy("word").agg(F.collect_set("fp").alias("at")).where(F.size("at") > 1)
    if max_bits == 2:
        stars = stars.select(F.array_min("at").alias("a"), F.explode("at").alias("b"))
    else:
        stars = stars.select(F.explode("at").alias("a"), "at").select("a", F.explode("at").alias("b"))
    stars = stars.where("a <> b").where(F.bit_count(F.expr("a ^ b")) <= max_bits)
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, max_bits: int = 2, width: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id (smallest doc_id reachable, itself included).

    Null or wordless texts have fingerprint zero and link like any other. Rows that repeat a doc_id each give a row.
    A null doc_id is kept and counts in its component only if no other row is in it. Further columns are not read.
    """
    prints = stage(fingerprints(docs, width), "fingerprints")
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_links(own.select("fp"), max_bits))
    own = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    own = stage(own, "roots")
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(own.join(least, "root").select("fp", "component_id"), "fp")


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_representatives(docs: DataFrame, max_bits: int = 2, width: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest; columns unchanged. Rows of one doc_id stay or go together,
    as they can't be told apart by id; a null doc_id stays if its component has no other."""
    kept = near_duplicates(docs, max_bits, width).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept._kept), "left_semi")
