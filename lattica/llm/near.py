"""Near-duplicate texts: SimHash and Golay keys nominate, an exact set-similarity join on shingles of five words completes.

A text is the set of the 64-bit hashes of its shingles; texts of one set are a class. A link is a Jaccard similarity of t or
more, verified on the whole sets. Links serve for components alone, so they are looked for step by step:

1. Each class is put to one class whose SimHash fingerprint over the same shingles is within two bits (found by Golay keys,
   see simhash.py), and to a few classes at its rare shingles, one for each in an order of its own.
2. Each class is put to a few classes of other components in the same way. Near copies mostly meet in these rounds, also large
   groups of them, of which no class is alike to all others.
3. Fingerprints can't promise all links, as texts of similarity 0.8 differ by some ten bits. So the prefix filter follows, for
   classes in different components alone, as a pair inside one changes nothing. Shingles are ordered by how much of the corpus
   their hash bucket holds (counted over all texts), then by hash; any order that all texts share gives an exact join. Of two
   similar sets, the larger has the first shingle that both share among its first n - ceil(t n) + 1, the smaller among its first
   n - ceil(2 t n / (1 + t)) + 1. Sizes and the places of that shingle bound what both can share at most, and so do parity
   bits, about as many as a set has shingles.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, discard, shrink, small_join, stage, words_of
from .components import connected_components
from .passages import _mix, _rolled
from .simhash import _LOWER, near_links

_BITS = 18
_PIECE = 1 << 12  # buckets of one row of counts
_PARITY = 512  # parity bits at least
_NONE = -(1 << 63)  # stands for a null doc_id in a join
_MOST = 300_000  # rows of one or two numbers that are broadcast at most


def _shingles(texts: list[str | None], width: int) -> tuple[list[int], np.ndarray]:
    """(number of shingles of each text, hashes of all one after the other), of lower-cased (A to Z) words; a text of fewer words
    is one shingle, one without words has none."""
    split = [words_of(t.translate(_LOWER) if t else None) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for own in split for w in own), np.uint64, int(sizes.sum()))
    # Runs that reach into the next text are left out; short texts are hashed as a whole.
    runs = _rolled(np.concatenate((hashes, np.zeros(width - 1, np.uint64))), width)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(hashes))
    starts = np.cumsum(sizes) - sizes
    short = (sizes > 0) & (sizes < width)
    for at, n in zip(starts[short].tolist(), sizes[short].tolist(), strict=True):
        runs[at] = _mix(np.array([xxhash.xxh64_intdigest(hashes[at : at + n].tobytes(), n)], np.uint64))[0]
    inside = left >= width
    inside[starts[short]] = True
    return np.where(short, 1, np.maximum(sizes - width + 1, 0)).tolist(), runs[inside]


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    counts, hashes = _shingles(texts, width)
    ends = np.cumsum(counts).tolist()
    return [np.unique(hashes[e - n : e]) for n, e in zip(counts, ends, strict=True)]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _BITS)).astype(np.int64)


def _levels(docs: DataFrame, width: int) -> np.ndarray:
    """For each bucket of hashes 0, or twice the binary logarithm of how many times the mean it holds."""

    def run(batches):
        from pyspark import TaskContext

        counts = np.zeros(1 << _BITS, np.int64)
        for (texts,) in chunks(batches, 0):
            counts += np.bincount(_bucket(_shingles(texts, width)[1]), minlength=1 << _BITS)
        part = TaskContext.get().partitionId() % 64
        for i in range(0, len(counts), _PIECE):
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([i], pa.int64()), pa.array([counts[i : i + _PIECE].tobytes()], pa.binary())], ["p", "i", "c"])

    def total(pdf):
        import pandas as pd

        sums = np.zeros(_PIECE, np.int64)
        for c in pdf["c"]:
            sums += np.frombuffer(c, np.int64)
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "c": [sums.tobytes()]})

    pieces = docs.select(F.col("text").cast("string")).mapInArrow(run, "p long, i long, c binary")
    # Summed in two steps, so that no task holds the pieces of all others.
    pieces = pieces.groupBy("p", "i").applyInPandas(total, "i long, c binary").groupBy("i").applyInPandas(total, "i long, c binary")
    counts = np.zeros(1 << _BITS, np.int64)
    # As many rows as the table has pieces.
    for r in pieces.collect():
        counts[r.i : r.i + _PIECE] = np.frombuffer(r.c, np.int64)
    mean = max(1e-9, counts.mean())
    return np.where(counts >= 1.5 * mean, np.minimum(255, 2 * np.log2(np.maximum(counts, 1) / mean)), 0).astype(np.uint8)


def _class(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def _parity(hashes: np.ndarray) -> np.ndarray:
    """Parity bits, a power of two of them and at least as many as hashes. Two sets differ in at least as many hashes as these."""
    bits = max(_PARITY, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else _PARITY
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _prints(docs: DataFrame, levels: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, k, n, fp, prefix, sig) of each row of docs: its class, the size of its set, its fingerprint, its first shingles in
    the order, parity bits."""

    def run(batches):
        for ids, texts in chunks(batches, 1):
            k, n, fp, prefix, sig = [], [], [], [], []
            for own in shingle_sets(texts, width):
                k.append(_class(own))
                n.append(len(own))
                fp.append(_fingerprint(own))
                most = len(own) - (len(own) * num + den - 1) // den + 1 if len(own) else 0
                prefix.append(own[np.argsort(levels[_bucket(own)], kind="stable")[:most]].view(np.int64))
                sig.append(_parity(own))
            ends = np.cumsum([0, *map(len, prefix)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix)))
            sigs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sig)]), pa.int32()), pa.array(np.concatenate(sig)))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.array(k, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), lists, sigs], ["doc_id", "k", "n", "fp", "prefix", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, k long, n long, fp long, prefix array<long>, sig array<long>")


def _size(p: str):
    return F.shiftright(F.col(p + "np"), 32)


def _bounds(a: str, b: str, num: int, den: int):
    """Whether postings a and b may be of the first shingle that two similar sets share, a the larger; columns np (size and
    place, 32 bits each) have these prefixes."""
    place = lambda p: F.col(p + "np").bitwiseAND(F.lit(0xFFFFFFFF))
    na, nb = _size(a), _size(b)
    reach = F.least(na - place(a), nb - place(b))
    return (nb <= na) & (nb * den >= na * num) & (reach * (num + den) >= (na + nb) * num)


def _differ(a: str, b: str):
    """The number of parity bits in which arrays a and b differ. Sets of similar sizes have as many bits, or one has twice as
    many: then its halves are put together."""
    short = _PARITY // 64
    plain = sum(F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(short))
    least = F.least(F.size(a), F.size(b))
    folded = lambda x: F.when(F.size(x) > least, F.zip_with(F.slice(x, 1, least), F.slice(x, least + 1, least), lambda u, v: u.bitwiseXOR(v))).otherwise(F.col(x))
    bits = F.zip_with(folded(a), folded(b), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.when((F.size(a) == short) & (F.size(b) == short), plain).otherwise(F.aggregate(bits, F.lit(0), lambda x, y: x + y))


def _nearest(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs(a, b) whose sizes and parity bits allow that they are similar."""
    slim = classes.select("k", "n", "sig")
    for p in ("a", "b"):
        pairs = pairs.join(slim.select(F.col("k").alias(p), F.col("n").alias(f"{p}_n"), F.col("sig").alias(f"{p}_sig")), p)
    pairs = pairs.where((F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num))
    return pairs.where(_differ("a_sig", "b_sig") * (num + den) <= (F.col("a_n") + F.col("b_n")) * (den - num)).select("a", "b")


def _verified(pairs: DataFrame, own: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of pairs(a, b) of classes whose whole sets are similar; own(k, least) names a document of each class."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    wanted = stage(own.join(ids, "k", "left_semi").select("k", F.coalesce("least", F.lit(_NONE).cast("long")).alias("d")), "wanted")

    def run(batches):
        for (texts,) in chunks(batches, 0):
            sets = shingle_sets(texts, width)
            ends = np.cumsum([0, *map(len, sets)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.record_batch([pa.array(np.array([_class(s) for s in sets], np.uint64).view(np.int64)), lists], ["k", "w"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE).cast("long")).alias("d"), F.col("text").cast("string").alias("text"))
    rows = small_join(rows, wanted.select("d").distinct(), ["d"], "left_semi", _MOST).select("text")
    sets = small_join(rows.mapInArrow(run, "k long, w array<long>"), wanted.select("k"), ["k"], "left_semi", _MOST)
    # One of each class, chosen by number: sets are large, so they aren't shuffled for it.
    every = stage(sets.withColumn("u", F.monotonically_increasing_id()), "sets")
    sets = small_join(every, every.groupBy("k").agg(F.min("u").alias("u")).select("u"), ["u"], "left_semi", _MOST)
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("w").alias("wa")), "a").join(sets.select(F.col("k").alias("b"), F.col("w").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    out = stage(both.where(common * (num + den) >= (F.size("wa") + F.size("wb")) * num).select("a", "b"), "links")
    discard(wanted, every)
    shrink(docs.sparkSession)
    return out


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """(a, b): each class with one class of a fingerprint within two bits, if there is any."""
    least = stage(classes.groupBy("fp").agg(F.min("k").alias("b")), "fingerprints")
    same = classes.join(least, "fp").where("k <> b").select(F.col("k").alias("a"), "b")
    links = near_links(least.select("fp"))
    links = links.union(links.select("b", "a")).groupBy("a").agg(F.min("b").alias("fp"))
    other = links.join(least, "fp").select(F.col("a").alias("fp"), "b").join(least.withColumnRenamed("b", "a"), "fp")
    return same.union(other.select("a", "b"))


def _most_shared(seen: DataFrame, each: int = 4) -> DataFrame:
    """(a, b): each class k with up to `each` of its hubs at the shingles h, those with which it has most of them among the hubs of
    one hash."""
    shared = seen.groupBy("k", "hub").count().withColumn("x", F.pmod(F.xxhash64("hub"), F.lit(each)))
    return shared.groupBy("k", "x").agg(F.max(F.struct("count", "hub")).alias("m")).select(F.col("k").alias("a"), F.col("m.hub").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, rounds: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, k (its class), component_id (smallest doc_id reachable, itself included) over links of
    texts whose shingle sets have Jaccard similarity num / den or more. The number of rounds with a few pairs for each class
    changes how many pairs are left for the join, not the result.

    Null or wordless texts are one class and link to each other alone. Rows that repeat a doc_id each give a row. A null
    doc_id is kept and counts in its component only if no other row is in it. Texts are read whole, however long. An empty
    table gives no rows. Further columns are not read.
    """
    spark = docs.sparkSession
    prints = stage(_prints(docs, _levels(docs, width), width, num, den).withColumn("u", F.monotonically_increasing_id()), "prints")
    own = stage(prints.groupBy("k").agg(F.min("doc_id").alias("least"), F.min("u").alias("u")), "classes")
    shrink(spark)
    # A row for each class, without shuffling what is large.
    classes = small_join(prints, own.select("u"), ["u"], "left_semi", _MOST).where("n > 0")
    posting = classes.select("k", "n", F.posexplode("prefix").alias("pos", "h"))
    posting = posting.select("h", "k", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("np"))
    w = Window.partitionBy("h")
    ends = posting.withColumns({"low": F.min("k").over(w), "high": F.max("k").over(w)})
    seen = stage(ends.where("low <> high").drop("low", "high"), "postings")
    shrink(spark)
    known, roots = [], None
    for turn in range(rounds + 1):
        # Shingles where classes of several components meet: there each class meets the first of another component in an order
        # that each shingle and round has for itself.
        open_ = seen.withColumn("root", F.col("k"))
        if roots is not None:
            open_ = seen.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
        place = F.struct(F.xxhash64("root", "h", F.lit(turn)).alias("x"), "root", "k")
        open_ = open_.withColumns({"low": F.min(place).over(w), "high": F.max(place).over(w)}).where("low.root <> high.root")
        open_ = open_.withColumn("hub", F.when(F.col("root") == F.col("low.root"), F.col("high.k")).otherwise(F.col("low.k")))
        open_ = stage(open_.drop("low", "high"), "open")
        if turn == rounds:
            break
        pairs = _most_shared(open_)
        if turn == 0:
            pairs = pairs.union(_by_fingerprint(classes))
        pairs = _nearest(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), classes, num, den)
        known.append(stage(pairs.select("a", "b"), "pairs"))
        shrink(spark)
        links = _verified(known[-1], own, docs, width, num, den)
        if roots is not None:
            links = links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = connected_components(links)
        discard(open_)
        shrink(spark)
    # Every pair of two components not yet looked at.
    full = open_.join(classes.select("k", "sig"), "k")
    one, other = (full.select("h", *(F.col(c).alias(f"{p}_{c}") for c in ("k", "np", "root", "sig"))) for p in ("a", "b"))
    ordered = (_size("b_") < _size("a_")) | (F.col("b_k") < F.col("a_k"))
    alike = _differ("a_sig", "b_sig") * (num + den) <= (_size("a_") + _size("b_")) * (den - num)
    again = one.join(other, "h").where((F.col("a_root") != F.col("b_root")) & ordered & _bounds("a_", "b_", num, den) & alike)
    again = again.select(F.greatest("a_k", "b_k").alias("a"), F.least("a_k", "b_k").alias("b")).distinct()
    again = stage(again.join(reduce(DataFrame.union, known), ["a", "b"], "left_anti"), "again")
    discard(open_)
    shrink(spark)
    if not again.isEmpty():
        more = _verified(again, own, docs, width, num, den)
        if not more.isEmpty():
            roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    discard(seen, again, *known)
    own = stage(own.select("k", "least").join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k")), "roots")
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "k").join(own.join(least, "root").select("k", "component_id"), "k")


def keep_representatives(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest; columns unchanged. Rows of one doc_id stay or go together,
    as they can't be told apart by id; a null doc_id stays if its component has no other."""
    found = near_duplicates(docs, width, num, den)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept._kept), "left_semi")
