"""Substring deduplication: recurring passages, and sharded Aho-Corasick automata that locate all of their occurrences.

Candidates. A window is 20 consecutive words; its mark is the smallest hash of its 13 runs of 8 words, so equal windows
have equal marks. Marks that stand once in the corpus are out of question; the others go to a Bloom filter of bounded size,
which only ever lets too much through. A block is a stretch of neighbouring windows with one mark. Of equal blocks all but
the first are recurring as a whole; windows of different blocks are compared one by one. So each recurring window is
known with the place where its words first stand, and windows that follow each other in both places form a passage.

Confirmation. The words of each passage are read from the place where it first stands. Each chunk of documents gets
the passages that concern it as an automaton (pyahocorasick), through which its whole documents are streamed; a word is removed if
it lies in an occurrence of a passage that first stands earlier. Texts that repeat an earlier one whole, word for word, are told
by their number of words and a 128-bit hash instead: they keep nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, discard, release, small_join, stage

WINDOW, GRAM = 20, 8
SPAN = WINDOW - GRAM + 1
_P = np.uint64(0x9E3779B97F4A7C15)
_NONE = -(1 << 63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * _P + h[j : j + len(out)]
    return _mix(out)


def blocks_of(texts: list[str | None]):
    """Blocks of the windows of texts: (marks, text number, first window's word, windows, window hashes, block hashes, repeats).

    The window hashes are of all blocks one after the other. repeats: whether windows of the block may be equal, as in a
    text that says the same words over and over.
    """
    split = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
    split = [w if len(w) >= WINDOW else [] for w in split]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    total = int(lengths.sum())
    empty = np.zeros(0, np.int64)
    if not total:
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for own in split for w in own), np.uint64, total)
    owner = np.repeat(np.arange(len(split)), lengths)
    starts = np.cumsum(lengths) - lengths
    grams, windows = _rolled(h, GRAM), _rolled(h, WINDOW)
    low, width = grams, 1
    while 2 * width <= SPAN:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    mark = np.minimum(low[: len(windows)], low[SPAN - width : SPAN - width + len(windows)])
    whole = np.flatnonzero(owner[: len(windows)] == owner[WINDOW - 1 :])
    mark, windows, owner = mark[whole], windows[whole], owner[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    inside = np.arange(len(whole)) - np.repeat(first, np.diff(np.append(first, len(whole))))
    # A mark stands for SPAN windows at most unless the text repeats itself: such a stretch is several blocks.
    first = np.flatnonzero(inside % SPAN == 0)
    n = np.diff(np.append(first, len(whole)))
    with np.errstate(over="ignore"):
        total_hash = np.add.reduceat(windows, first)
        block = _mix(windows[first] * _P + windows[first + n - 1] * np.uint64(0xC2B2AE3D27D4EB4F) + total_hash * np.uint64(0x165667B19E3779F9) + n.astype(np.uint64))
    again = np.zeros(len(grams) + 1, np.int64)
    for k in range(1, min(SPAN, len(grams))):
        again[1:-k][grams[:-k] == grams[k:]] = 1
    again = np.cumsum(again)
    repeats = again[np.minimum(whole[first] + n + SPAN - 1, len(grams))] > again[whole[first]]
    return mark[first], owner[first], whole[first] - starts[owner[first]], n, windows, block, repeats


class Bloom:
    """Two bits for each value in a table of a power of two bits."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) * 8 - 1)

    @staticmethod
    def places(values: np.ndarray, mask: np.uint64):
        return (values & mask, (values >> np.uint64(32)) * _P & mask)

    def has(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for at in self.places(values, self.mask):
            out &= (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _bloom(values: DataFrame, most_bits: int = 1 << 26, piece: int = 1 << 16) -> Bloom:
    """values(v long). At most most_bits bits, however many values there are."""
    bits = 1 << 19
    n = values.count()
    while bits < 16 * n and bits < most_bits:
        bits *= 2

    def run(batches):
        table, mask = np.zeros(bits // 8, np.uint8), np.uint64(bits - 1)
        for batch in batches:
            for at in Bloom.places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), mask):
                np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for i in range(0, len(table), piece):
            if table[i : i + piece].any():
                yield pa.record_batch([pa.array([i], pa.int64()), pa.array([table[i : i + piece].tobytes()], pa.binary())], ["i", "b"])

    def both(pdf):
        import pandas as pd

        out = np.zeros(len(pdf["b"].iloc[0]), np.uint8)
        for b in pdf["b"]:
            out |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "b": [out.tobytes()]})

    table = np.zeros(bits // 8, np.uint8)
    # As many rows as the table has pieces.
    for r in values.coalesce(12).mapInArrow(run, "i long, b binary").groupBy("i").applyInPandas(both, "i long, b binary").collect():
        table[r.i : r.i + len(r.b)] = np.frombuffer(r.b, np.uint8)
    return Bloom(table)


def _keyed(docs: DataFrame) -> DataFrame:
    """(d, th, text): d is the doc_id, least of all if null; th tells texts of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE).cast("long")).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))


def _copies(rows: DataFrame) -> DataFrame:
    """(d, th) of the texts of WINDOW words or more whose words all stand, in the same order, in an earlier text."""

    def run(batches):
        for d, th, texts in chunks(batches, 2):
            n, one, two = [], [], []
            for t in texts:
                w = t.encode("utf-8", "replace").split() if t else []
                h = xxhash.xxh3_128_intdigest(b" ".join(w))
                n.append(len(w))
                one.append((h >> 64) - (1 << 63))
                two.append((h & ((1 << 64) - 1)) - (1 << 63))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (d, th, n, one, two)], ["d", "th", "n", "one", "two"])

    prints = stage(rows.mapInArrow(run, "d long, th long, n long, one long, two long").where(F.col("n") >= WINDOW), "sequences")
    # Written, so that the join below reads plain exchanges, which are split where many texts are one.
    first = stage(prints.groupBy("n", "one", "two").agg(F.min(F.struct("d", "th")).alias("first"), F.count("*").alias("c")).where("c > 1"), "firsts")
    return prints.join(first, ["n", "one", "two"]).where(F.struct("d", "th") != F.col("first")).select("d", "th").distinct()


def recurring(rows: DataFrame) -> DataFrame:
    """rows(d, th, text): passages (d, th, fd, fth, fs, n): n words of the text d, th that first stand at word fs of the text fd, fth."""

    def marks(batches):
        for (texts,) in chunks(batches, 0):
            mark, _, _, _, _, _, repeats = blocks_of(texts)
            v, c = np.unique(np.concatenate((mark, mark[repeats])), return_counts=True)
            yield pa.record_batch([pa.array(v.view(np.int64)), pa.array(np.minimum(c, 2))], ["v", "c"])

    seen = rows.select("text").mapInArrow(marks, "v long, c long").groupBy("v").agg(F.sum("c").alias("c"))
    marks_ = stage(seen.where("c > 1").select("v"), "marks")
    bloom = _bloom(marks_)

    def blocks(batches):
        for d, th, texts in chunks(batches, 2):
            mark, owner, at, n, windows, block, _ = blocks_of(texts)
            keep = bloom.has(mark)
            inside = np.repeat(keep, n)
            w = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[keep]))).astype(np.int32)), pa.array(windows[inside].view(np.int64)))
            own = owner[keep]
            cols = [pa.array(block[keep].view(np.int64)), pa.array(np.array(d, np.int64)[own]), pa.array(np.array(th, np.int64)[own]), pa.array(at[keep].astype(np.int32)), w]
            yield pa.record_batch(cols, ["block", "d", "th", "s", "w"])

    found = stage(rows.mapInArrow(blocks, "block long, d long, th long, s int, w array<long>"), "blocks")
    # Rows of one text that repeat are one document. Firsts are written before they are joined: a block or window that stands in
    # very many documents is a large key on one side only, which is then split over tasks.
    place = F.struct("d", "th", "s")
    first = stage(found.groupBy("block").agg(F.min(place).alias("f"), F.count("*").alias("c")), "firsts")
    alone = found.join(first.where("c = 1").select("block"), "block", "left_semi")
    many = stage(found.join(first.where("c > 1"), "block").withColumn("later", F.struct("d", "th", "s") != F.col("f")), "many")
    later = many.where("later").select("d", "th", "s", F.size("w").alias("k"), "f")
    windows = alone.union(many.where("not later").select(alone.columns)).select("d", "th", F.posexplode("w").alias("i", "h"), "s").select("h", "d", "th", (F.col("s") + F.col("i")).alias("s"))
    windows = stage(windows, "windows")
    heads = stage(windows.groupBy("h").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1").select("h", "f"), "heads")
    discard(marks_, found, first)
    ahead = windows.join(heads, "h").where(F.struct("d", "th", "s") != F.col("f"))
    every = later.union(ahead.select("d", "th", "s", F.lit(1), "f")).select("d", "th", "s", "k", "f.*").toDF("d", "th", "s", "k", "fd", "fth", "fs")
    # Stretches whose windows follow one another here and there: one passage.
    w = Window.partitionBy("d", "th").orderBy("s", "fs")
    step = (F.lag("fd").over(w) == F.col("fd")) & (F.lag("fth").over(w) == F.col("fth")) & (F.lag(F.col("fs") - F.col("s")).over(w) == F.col("fs") - F.col("s")) & (F.lag(F.col("s") + F.col("k")).over(w) == F.col("s"))
    runs = every.withColumn("g", F.when(F.coalesce(step, F.lit(False)), 0).otherwise(1)).withColumn("g", F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("d", "th", "g").agg(F.first("fd").alias("fd"), F.first("fth").alias("fth"), F.min("fs").alias("fs"), (F.sum("k") + WINDOW - 1).alias("n"))
    return spans.select("d", "th", "fd", "fth", "fs", F.col("n").cast("int").alias("n")).distinct()


def _with_words(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """spans with a column words: the words of each passage, read where it first stands, joined by blanks."""
    wanted = spans.select("fd", "fth", "fs", "n").distinct().groupBy("fd", "fth").agg(F.collect_list(F.struct("fs", "n")).alias("at"))
    joined = rows.withColumnsRenamed({"d": "fd", "th": "fth"}).join(wanted, ["fd", "fth"])

    def cut(batches):
        for fd, fth, texts, wanted in chunks(batches, 2):
            out: list[list] = [[], [], [], [], []]
            for a, b, t, places in zip(fd, fth, texts, wanted, strict=True):
                words = t.encode("utf-8", "replace").split()
                for p in places:
                    for c, x in zip(out, (a, b, p["fs"], p["n"], b" ".join(words[p["fs"] : p["fs"] + p["n"]]).decode()), strict=True):
                        c.append(x)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["fd", "fth", "fs", "n", "words"])

    cutting = joined.select("fd", "fth", "text", "at").mapInArrow(cut, "fd long, fth long, fs int, n int, words string")
    return spans.join(stage(cutting.dropDuplicates(["fd", "fth", "fs", "n"]), "passages"), ["fd", "fth", "fs", "n"])


def covered(words: list[str], own: tuple, automaton) -> np.ndarray:
    """Which words lie in an occurrence of a passage that first stands before the place found; own is (d, th)."""
    change = np.zeros(len(words) + 1, np.int64)
    text = " " + " ".join(words) + " "
    starts = np.cumsum([1] + [len(w) + 1 for w in words])
    for end, (size, n, first) in automaton.iter(text):
        at = int(np.searchsorted(starts, end - size + 2))
        if first < (*own, at):
            change[at] += 1
            change[at + n] -= 1
    return np.cumsum(change[:-1]) > 0


def automaton_of(passages: dict[str, tuple]):
    """passages: words joined by blanks to (d, th, s) where they first stand. None if there are none."""
    import ahocorasick

    if not passages:
        return None
    out = ahocorasick.Automaton()
    for words, first in passages.items():
        out.add_word(f" {words} ", (len(words) + 2, words.count(" ") + 1, first))
    out.make_automaton()
    return out


def dedup_passages(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, n_words, n_removed, kept_sha256, and kept if with_text.

    A word goes if a window of 20 words of its document covers it whose words also start earlier: in a document of smaller
    doc_id (of smaller text hash, where a doc_id repeats) or before in the same one. Null texts have no words; a null doc_id
    is before all others; rows that repeat doc_id and text are one document. kept holds the words that stay, by blanks.
    Texts are read whole, however long; an empty table gives no rows; other columns are not read.
    """
    rows = _keyed(docs)
    copies = stage(_copies(rows), "copies")
    release(docs.sparkSession)
    spans = stage(recurring(small_join(rows, copies, ["d", "th"], "left_anti", 500_000)), "spans")
    release(docs.sparkSession)
    parts = _with_words(spans, small_join(rows, copies, ["d", "th"], "left_anti", 500_000))
    own = parts.groupBy("d", "th").agg(F.collect_list(F.struct("words", "fd", "fth", "fs")).alias("parts"))
    whole = copies.withColumn("copy", F.lit(True))
    final = small_join(rows, whole, ["d", "th"], "left", 500_000).join(own, ["d", "th"], "left")

    def run(batches):
        for d, th, texts, copy, parts in chunks(batches, 2, max_chars=1_000_000):
            passages: dict[str, tuple] = {}
            for own in parts:
                for p in own or ():
                    place = (p["fd"], p["fth"], p["fs"])
                    passages[p["words"]] = min(place, passages.get(p["words"], place))
            automaton = automaton_of(passages)
            cols: list[list] = [[], [], [], [], []]
            for a, b, text, is_copy in zip(d, th, texts, copy, strict=True):
                words = [w.decode() for w in text.encode("utf-8", "replace").split()] if text else []
                if is_copy:
                    kept = []
                elif automaton is None or len(words) < WINDOW:
                    kept = words
                else:
                    gone = covered(words, (a, b), automaton)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                kept_text = " ".join(kept)
                for c, x in zip(cols, (None if a == _NONE else a, len(words), len(words) - len(kept), hashlib.sha256(kept_text.encode()).hexdigest(), kept_text), strict=True):
                    c.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            n = len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols[:n], types[:n], strict=True)], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    return final.select("d", "th", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "parts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
