"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are lower-cased runs of letters and digits. A seed is a pair of words of an item that stand at most three apart: of the
pairs that begin at a word, the two whose words are rarest together over all documents (only their order counts, so neither the
corpus's size nor an item's own copies change which pairs are seeds). All documents are searched for pairs of words that stand
at most three apart. Where seeds that lie on nearby diagonals touch at least a quarter of an item's words, the passage is aligned
with the whole item. Edited copies keep such pairs where no longer run of words is left. An item is found in a document if a
local alignment scores at least min_share of what the whole item would score against itself, and at least what eight
words, or a shorter item as a whole, would.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, chunks

MATCH, MISMATCH, GAP = 2, -1, -1
REACH = 3
LEAST_WORDS, LEAST_MATCH = 3, 8
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


class _Numbers(dict):
    """Words to numbers; -1 for words that aren't there."""

    def __missing__(self, word: str) -> int:
        return -1


class Index:
    """A benchmark's items as numbers of its own words; items of fewer than LEAST_WORDS words are left out."""

    def __init__(self, items: list[tuple[int, str]]):
        split = [(i, tokens(t)) for i, t in items]
        split = [(i, t) for i, t in split if len(t) >= LEAST_WORDS]
        self.number = _Numbers((w, k) for k, w in enumerate(sorted({w for _, t in split for w in t})))
        self.ids = [i for i, _ in split]
        self.items = [np.array([self.number[w] for w in t], np.int64) for _, t in split]

    def numbers(self, text: str | None) -> np.ndarray:
        """The benchmark's numbers of a text's words; -1 for words that it doesn't have."""
        own = tokens(text)
        return np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))


def word_counts(docs: DataFrame, index: Index) -> np.ndarray:
    """How often each word of the benchmark stands in all documents."""
    number = index.number

    def run(batches):
        counts = np.zeros(len(number) + 1, np.int64)
        for (texts,) in chunks(batches, 0):
            counts += np.bincount(np.concatenate([index.numbers(t) for t in texts]) + 1, minlength=len(counts))
        counts = counts[1:]
        which = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(which), pa.array(counts[which])], ["w", "c"])

    # One row for each word of the benchmark, however many documents there are.
    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).collect()
    out = np.zeros(len(number), np.int64)
    for r in rows:
        out[r.w] = r.c
    return out


def rare_pairs(index: Index, counts: np.ndarray, each: int = 2) -> tuple[np.ndarray, ...]:
    """(first word, second word, item, place of the first, distance) of the seeds: for each place of an item, of the pairs that begin there
    the `each` whose words are rarest together, nearer ones first among equals."""
    empty = np.zeros(0, np.int64)
    if not index.items:
        return (empty,) * 5
    flat, sizes = np.concatenate(index.items), np.array([len(x) for x in index.items])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    share = np.log(np.maximum(counts, 1))
    weight = np.full((len(flat), REACH), np.inf)
    for g in range(1, REACH + 1):
        at = np.flatnonzero(place + g < sizes[owner])
        weight[at, g - 1] = share[flat[at]] + share[flat[at + g]]
    order = np.argsort(weight, axis=1, kind="stable")[:, :each]
    at, k = np.nonzero(np.isfinite(np.take_along_axis(weight, order, 1)))
    gap = order[at, k] + 1
    return flat[at], flat[at + gap], owner[at], place[at], gap


def smith_waterman(query: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int, int]:
    """(score, query start, query end, passage start, passage end) of the best local alignment; ends are exclusive.

    Row by row: a gap along the row is a running maximum once each cell is freed of the cost to reach it. The earliest
    best cell wins; the way back prefers the diagonal.
    """
    n, m = len(query), len(passage)
    h = np.zeros((n + 1, m + 1), np.int64)
    cost = GAP * np.arange(m + 1)
    for i in range(1, n + 1):
        diagonal = h[i - 1, :-1] + np.where((passage == query[i - 1]) & (passage >= 0), MATCH, MISMATCH)
        row = np.maximum(np.maximum(diagonal, h[i - 1, 1:] + GAP), 0)
        h[i, 1:] = np.maximum(np.maximum.accumulate(np.concatenate(([0], row)) - cost)[1:] + cost[1:], row)
    best = int(h.argmax())
    i, j = divmod(best, m + 1)
    score, qe, pe = int(h[i, j]), i, j
    while i and j and h[i, j] > 0:
        s = MATCH if query[i - 1] == passage[j - 1] else MISMATCH
        if h[i, j] == h[i - 1, j - 1] + s:
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, i, qe, j, pe


class Matcher:
    """Finds a benchmark's items in documents by seeds and alignment."""

    def __init__(self, index: Index, counts: np.ndarray, min_share: float):
        self.index, self.base = index, len(index.number) + 1
        first, second, item, place, gap = rare_pairs(index, counts)
        key = first * self.base + second
        order = np.lexsort((place, item, key))
        self.keys, begins = np.unique(key[order], return_index=True)
        self.begins = np.append(begins, len(key))
        self.item, self.place, self.gap = item[order].astype(np.int32), place[order].astype(np.int32), gap[order].astype(np.int32)
        self.sizes = np.array([len(x) for x in index.items], np.int64)
        # Words of an item that seeds must touch, and how far the diagonals of one copy may lie apart.
        self.need, self.drift = np.maximum(2, -(-self.sizes // 4)), self.sizes // 4 + 2
        self.least = np.maximum(min_share * MATCH * self.sizes, MATCH * np.minimum(self.sizes, LEAST_MATCH))
        self.shift = np.uint64(64 - max(16, (4 * len(self.keys)).bit_length()))
        self.known = np.zeros(1 << int(64 - self.shift), bool)
        self.known[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _P) >> self.shift).astype(np.int64)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of a seed's first word, number of the seed's entry) of all seeds among words (-1: not of the benchmark)."""
        places, entries = [], []
        for g in range(1, REACH + 1):
            at = np.flatnonzero((words[:-g] >= 0) & (words[g:] >= 0))
            key = words[at] * self.base + words[at + g]
            maybe = self.known[self._slot(key)]
            at, key = at[maybe], key[maybe]
            if len(key):
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[k] == key
                at, k = at[hit], k[hit]
                n = self.begins[k + 1] - self.begins[k]
                entries.append(np.repeat(self.begins[k] - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
                places.append(np.repeat(at, n))
        return (np.concatenate(places), np.concatenate(entries)) if places else (np.zeros(0, np.int64),) * 2

    def windows(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, begin, end): the parts of documents to align with items, in order. words holds the documents at
        starts to ends, REACH or more others between them.

        Diagonals are dealt to bands of twice the drift that overlap by half, so the seeds of a copy lie in one band together.
        """
        at, entry = self.hits(words)
        doc = np.searchsorted(starts, at, "right") - 1
        item, place = self.item[entry].astype(np.int64), self.place[entry].astype(np.int64)
        pair = doc * len(self.sizes) + item
        own, n = np.unique(pair, return_counts=True)
        many = (2 * n >= self.need[own % max(1, len(self.sizes))])[np.searchsorted(own, pair)] if len(pair) else np.zeros(0, bool)
        at, entry, doc, item, place, pair = (x[many] for x in (at, entry, doc, item, place, pair))
        if not len(at):
            return []
        band = (at - starts[doc] - place) // self.drift[item]
        low, width, size = int(band.min()) - 1, int(band.max() - band.min()) + 2, int(self.sizes.max()) + 1
        cell = np.concatenate((pair * width + band - low, pair * width + band - 1 - low))
        touched = np.concatenate((cell * size + np.tile(place, 2), cell * size + np.tile(place + self.gap[entry], 2)))
        cells, n = np.unique(np.unique(touched) // size, return_counts=True)
        out: list[list[int]] = []
        for c in cells[n >= self.need[cells // width % len(self.sizes)]].tolist():
            (i, k), b = divmod(c // width, len(self.sizes)), c % width + low
            d, length = int(self.drift[k]), int(self.sizes[k])
            begin, end = max(0, (b - 1) * d), min(int(ends[i] - starts[i]), (b + 3) * d + length)
            if out and out[-1][:2] == [i, k] and begin <= out[-1][3] and end - out[-1][2] <= 3 * length + 8:
                out[-1][3] = end
            else:
                out.append([i, k, begin, end])
        return [tuple(x) for x in out]

    def find_all(self, texts: list[str | None]) -> list[list[tuple[int, int, float, int, int]]]:
        """For each text (item id, score, share, first word, end word): for each item its best passage in the text, if it's good
        enough; of passages with the same score the first."""
        docs = [self.index.numbers(t) for t in texts]
        gap = np.full(REACH, -1, np.int64)
        ends = np.cumsum([len(d) + REACH for d in docs]) - REACH
        starts = ends - np.array([len(d) for d in docs], np.int64)
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in docs]
        seen: dict[tuple[int, int, bytes], int] = {}
        for i, k, a, b in self.windows(np.concatenate([x for d in docs for x in (d, gap)]) if docs else gap, starts, ends):
            passage = docs[i][a:b]
            # A text that repeats itself is aligned once for each different passage.
            if seen.setdefault((i, k, passage.tobytes()), a) != a:
                continue
            score, _, _, p, q = smith_waterman(self.index.items[k], passage)
            if k not in best[i] or score > best[i][k][0]:
                best[i][k] = (score, a + p, a + q)
        shares = MATCH * self.sizes
        return [sorted((self.index.ids[k], score, score / int(shares[k]), p, q) for k, (score, p, q) in own.items() if score >= self.least[k]) for own in best]

    def find(self, text: str | None) -> list[tuple[int, int, float, int, int]]:
        return self.find_all([text])[0]


_P = np.uint64(0x9E3779B97F4A7C15)


def prepare(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.5, most_words: int = 2_000_000) -> list[Matcher]:
    """benchmark(item_id, text): a test set. Its items are dealt by hash to as many parts as keep each at about most_words
    words; each part is read to the driver in turn and becomes a Matcher. Null items are left out."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    words = items.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"))))).first()[0] or 0
    parts = max(1, math.ceil(words / most_words))
    out = []
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        index = Index(sorted((r.item_id, r.text) for r in own))
        out.append(Matcher(index, word_counts(docs, index), min_share))
    return out


def find(docs: DataFrame, matchers: list[Matcher]) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, score, share, start, end (words of the document).

    Null and empty texts have none; rows that repeat are each searched; items of the same text are found alike; of equal
    alignments the first is given. Texts are read whole, however long. An empty table gives no rows. Other columns are not read.
    """

    def finder(matcher):
        def run(batches):
            for ids, texts in chunks(batches, 1):
                rows = [(i, *hit) for i, own in zip(ids, matcher.find_all(texts), strict=True) for hit in own]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "score", "share", "start", "end"])

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score long, share double, start long, end long"
    return reduce(DataFrame.union, [rows.mapInArrow(finder(m), schema) for m in matchers])


def keep_clean(docs: DataFrame, matchers: list[Matcher]) -> DataFrame:
    """The rows of docs in which no item is found; all columns unchanged, in one pass over the texts for each matcher."""

    def cleaner(matcher):
        def run(batches):
            for batch in batches:
                flags = []
                for (texts,) in chunks(iter([batch.select(["text"])]), 0):
                    flags += [not own for own in matcher.find_all(texts)]
                yield batch.filter(pa.array(flags, pa.bool_()))

        return run

    return reduce(lambda rows, m: rows.mapInArrow(cleaner(m), docs.schema), matchers, docs)
