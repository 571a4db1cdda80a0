"""Language identification by a linear-chain conditional random field over the words of a text.

Each word has emission scores from hashed features of its lower-cased letters: affixes (up to four bytes at either end),
n-grams inside (one to four bytes) and the lexicon (frequent words of the training sample). Learned transitions tie the
labels of neighbouring words; forward-backward gives each word's posteriors, which a text's prediction averages. The field is
trained on stitched texts too, in which the language changes, so that the transitions learn code-switching.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

BUCKETS = 1 << 15
UNKNOWN = "und"
_RANGE = 1 << 30


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample_by_label(rows: DataFrame, label: str, per_label: int, columns: list[str]) -> list:
    """At most per_label rows of each label, those of the smallest hash of doc_id, so that reruns agree.

    A label's count gives the part of the hash's range that should hold twice as many ids as are wanted; it is widened where it
    doesn't. So no task gathers a label, however many rows it has; the driver gets some times per_label ids of each.
    """
    slim = rows.select("doc_id", F.col(label).alias("y")).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    counts = {r.y: r.n for r in slim.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place, open_, chosen = F.pmod(F.xxhash64("doc_id"), F.lit(_RANGE)), {y: min(_RANGE, 2 * per_label * _RANGE // n + 1) for y, n in counts.items()}, []
    while open_:
        inside = reduce(or_, ((F.col("y") == F.lit(y)) & (place < most) for y, most in open_.items()))
        found: dict = {y: [] for y in open_}
        for r in slim.where(inside).select("y", place.alias("p"), "doc_id").distinct().collect():
            found[r.y].append((r.p, r.doc_id))
        done = [y for y, most in open_.items() if len(found[y]) >= per_label or most == _RANGE]
        chosen += [i for y in done for _, i in sorted(found[y])[:per_label]]
        open_ = {y: min(_RANGE, 4 * most) for y, most in open_.items() if y not in done}
    if not chosen:
        return []
    ids = rows.sparkSession.createDataFrame([(int(i),) for i in set(chosen)], "doc_id long")
    # per_label rows of each label: few, so the texts are met by a broadcast.
    return one_each(rows.where(F.col(label).isNotNull()).join(F.broadcast(ids), "doc_id", "left_semi").select(*columns))


def one_each(rows: DataFrame) -> list:
    """One row for each doc_id, the least, collected: however often a sampled id repeats, the sample stays small."""
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "r.*").collect()


class Features:
    """Hashed feature numbers of words, many at a time."""

    def __init__(self, lexicon: list[bytes]):
        self.lexicon = {w: BUCKETS + i for i, w in enumerate(lexicon)}
        self.size = BUCKETS + len(lexicon)

    @staticmethod
    def plain(word: bytes) -> bytes:
        """The word's letters in lower case; empty if it has none."""
        text = word.decode("utf-8", "replace").lower()
        if text.isalpha():
            return text.encode()
        return "".join(c for c in text if c.isalpha()).encode()

    def of(self, plain: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, word positions); words without letters have none."""
        data = np.frombuffer(b"".join(plain), np.uint8).astype(np.uint32) + np.uint32(1)
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(plain)), sizes)
        place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
        left = np.repeat(sizes, sizes) - place
        numbers, owners = [], []
        h = np.zeros(len(data), np.uint32)
        for n in range(1, 5):
            valid = left >= n
            shifted = np.zeros_like(data)
            if len(data) >= n:
                shifted[: len(data) - n + 1] = data[n - 1 :]
            h = h * np.uint32(0x01000193) + shifted * np.uint32(0x9E3779B1)
            # Inner n-grams, then those at the beginning and at the end, each kind by a salt of its own.
            for salt, which in ((n, valid), (16 + n, valid & (place == 0)), (32 + n, valid & (left == n))):
                own = h[which] ^ np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)
                own = (own ^ own >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
                numbers.append((own ^ own >> np.uint32(12)) % np.uint32(BUCKETS))
                owners.append(owner[which])
        known = [(self.lexicon[w], i) for i, w in enumerate(plain) if w in self.lexicon]
        numbers.append(np.array([x[0] for x in known], np.uint32))
        owners.append(np.array([x[1] for x in known], np.int64))
        return np.concatenate(numbers).astype(np.int64), np.concatenate(owners)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray, expected: bool = False):
    """Posteriors of the labels of all words of many texts.

    emission: positive scores (words x labels), text after text; lengths: of the texts; transition, start: positive.
    All texts advance together, longest first, so that the texts still running are the first rows of each step.
    With expected, also the expected counts of label pairs.
    """
    k = emission.shape[1]
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    steps = int(sorted_lengths[0]) if len(lengths) else 0
    running = np.searchsorted(-sorted_lengths, -np.arange(steps), side="left")
    offset = np.concatenate(([0], np.cumsum(running)))
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    starts = np.cumsum(lengths) - lengths
    step = np.arange(len(emission)) - np.repeat(starts, lengths)
    where = offset[step] + np.repeat(rank, lengths)
    e = np.empty_like(emission)
    e[where] = emission
    alpha = np.empty_like(e)
    for t in range(steps):
        own = slice(offset[t], offset[t + 1])
        a = e[own] * start if t == 0 else (alpha[offset[t - 1] : offset[t - 1] + running[t]] @ transition) * e[own]
        alpha[own] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((k, k))
    posterior = np.empty_like(e)
    beta = np.ones((0, k), e.dtype)
    for t in range(steps - 1, -1, -1):
        n = running[t]
        own = slice(offset[t], offset[t + 1])
        if t + 1 < steps:
            m = running[t + 1]
            ahead = e[offset[t + 1] : offset[t + 2]] * beta
            new = np.ones((n, k), e.dtype)
            new[:m] = ahead @ transition.T
            if expected:
                a = alpha[own][:m]
                z = (a * new[:m]).sum(1)
                pairs += transition * (a.T @ (ahead / z[:, None]))
        else:
            new = np.ones((n, k), e.dtype)
        beta = new / new.sum(1, keepdims=True)
        p = alpha[own] * beta
        posterior[own] = p / p.sum(1, keepdims=True)
    return (posterior[where], pairs) if expected else posterior[where]


class Crf:
    """Labels, feature weights, transitions; trained by gradient steps on the log-likelihood."""

    def __init__(self, labels: list[str], lexicon: list[bytes]):
        self.labels, self.features = labels, Features(lexicon)
        k = len(labels)
        self.weights = np.zeros((self.features.size, k), np.float32)
        self.transition = np.zeros((k, k), np.float32)
        self.start = np.zeros(k, np.float32)

    def scores(self, plain: list[bytes]) -> np.ndarray:
        """Emission scores of words (their letters in lower case)."""
        numbers, owners = self.features.of(plain)
        out = np.zeros((len(plain), len(self.labels)), np.float32)
        for j in range(len(self.labels)):
            out[:, j] = np.bincount(owners, self.weights[numbers, j], len(plain))
        return out

    @classmethod
    def train(cls, texts: list[list[bytes]], labels: list[str], seed: int = 7, epochs: int = 3, lexicon_size: int = 4000, batch_words: int = 20_000, rate: float = 0.3) -> Crf:
        """texts: the words' letters in lower case, none empty; labels: one for each text, of all its words."""
        names = sorted(set(labels))
        counts = Counter(w for t in texts for w in t)
        crf = cls(names, [w for w, n in counts.most_common(lexicon_size) if n >= 3])
        rng, number = np.random.default_rng(seed), {x: i for i, x in enumerate(names)}
        spans = []
        for text, label in zip(texts, labels, strict=True):
            at = 0
            while at < len(text):
                n = int(rng.integers(8, 64))
                spans.append((text[at : at + n], number[label]))
                at += n
        squares, tsq, ssq = np.full(crf.weights.shape, 1e-6, np.float32), np.full(crf.transition.shape, 1e-3, np.float32), np.full(len(names), 1e-3, np.float32)
        for _ in range(epochs):
            order, batch, size = rng.permutation(len(spans)), [], 0
            for i, at in enumerate(order):
                batch.append(spans[at])
                size += len(spans[at][0])
                if size < batch_words and i + 1 < len(order):
                    continue
                # Half of the spans follow one another in one text each two: the language may change in it.
                sequences = [[x] for x in batch[: len(batch) // 2]] + [list(x) for x in zip(batch[len(batch) // 2 :: 2], batch[len(batch) // 2 + 1 :: 2])]
                words = [w for s in sequences for x in s for w in x[0]]
                gold = np.array([x[1] for s in sequences for x in s for _ in x[0]])
                lengths = np.array([sum(len(x[0]) for x in s) for s in sequences])
                batch, size = [], 0
                if not len(words):
                    continue
                vocabulary = {w: j for j, w in enumerate(dict.fromkeys(words))}
                place = np.array([vocabulary[w] for w in words])
                numbers, owners = crf.features.of(list(vocabulary))
                k, v = len(names), len(vocabulary)
                sc = np.stack([np.bincount(owners, crf.weights[numbers, j], v) for j in range(k)], 1)
                e = np.exp(sc - sc.max(1, keepdims=True))[place]
                posterior, pairs = forward_backward(e, lengths, np.exp(crf.transition).astype(float), np.exp(crf.start).astype(float), expected=True)
                delta = -posterior
                delta[np.arange(len(gold)), gold] += 1
                by_word = np.stack([np.bincount(place, delta[:, j], v) for j in range(k)], 1)
                for j in range(k):
                    g = np.bincount(numbers, by_word[owners, j], crf.features.size).astype(np.float32) / len(words)
                    squares[:, j] += g * g
                    crf.weights[:, j] += rate * g / np.sqrt(squares[:, j]) * (g != 0)
                starts = np.cumsum(lengths) - lengths
                seen = np.zeros((k, k))
                inner = np.ones(len(gold), bool)
                inner[starts] = False
                at_inner = np.flatnonzero(inner)
                np.add.at(seen, (gold[at_inner - 1], gold[at_inner]), 1)
                g = ((seen - pairs) / len(words)).astype(np.float32)
                tsq += g * g
                crf.transition += rate * g / np.sqrt(tsq)
                g = (np.bincount(gold[starts], minlength=k) - posterior[starts].sum(0)).astype(np.float32) / len(starts)
                ssq += g * g
                crf.start += 0.1 * rate * g / np.sqrt(ssq)
        return crf


class Tagger:
    """Applies a field to texts; keeps the emission scores of up to limit words."""

    def __init__(self, crf: Crf, limit: int = 300_000):
        self.crf, self.limit = crf, limit
        self.transition, self.start = np.exp(crf.transition).astype(np.float32), np.exp(crf.start).astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        self.places, self.table = {}, np.ones((0, len(self.crf.labels)), np.float32)

    def word_posteriors(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(posteriors, lengths, whether a word has letters) of the words of texts; words without letters are neutral."""
        words = [w for t in texts for w in t]
        new = set(words) - self.places.keys()
        if len(self.places) + len(new) > self.limit:
            self._forget()
            new = set(words)
        if new:
            new = list(new)
            plain = [Features.plain(w) for w in new]
            scores = self.crf.scores(plain)
            scores = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -20))
            scores[[not p for p in plain]] = 1
            bare = np.array([not p for p in plain])
            scores[bare] = 2  # all labels alike; told apart from words with letters, whose largest score is 1
            self.places.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate((self.table, scores.astype(np.float32)))
        emission = self.table[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        return forward_backward(emission, lengths, self.transition, self.start), lengths, emission[:, 0] < 1.5 if emission.shape[1] else np.zeros(0, bool)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(label, mean posterior over the words with letters) of each text; UNKNOWN and 0 without letters."""
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        split = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
        which = [i for i, w in enumerate(split) if w]
        if not which or not self.crf.labels:
            return labels, scores
        posterior, lengths, lettered = self.word_posteriors([split[i] for i in which])
        starts = np.cumsum(lengths) - lengths
        total = np.add.reduceat(posterior * lettered[:, None], starts, axis=0, dtype=np.float64)
        n = np.add.reduceat(lettered.astype(np.int64), starts)
        for i, row, count in zip(which, total, n.tolist(), strict=True):
            if count:
                best = int(row.argmax())
                labels[i], scores[i] = self.crf.labels[best], min(1.0, float(row[best]) / count)
        return labels, scores


def train(docs: DataFrame, per_label: int = 250) -> Crf:
    """A field from at most per_label whole texts of each non-null lang, of rows that aren't held out."""
    rows = docs.where(~held_out() & F.col("text").isNotNull())
    sample = sorted(sample_by_label(rows, "lang", per_label, ["doc_id", "text", "lang"]), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))
    texts, labels = [], []
    for row in sample:
        words = [p for p in map(Features.plain, row.text.encode("utf-8", "replace").split()) if p]
        if words:
            texts.append(words)
            labels.append(row.lang)
    return Crf.train(texts, labels)


def identify(docs: DataFrame, crf: Crf) -> DataFrame:
    """docs(doc_id, text, ...) to one row each: doc_id, held_out, lang_pred, score.

    lang_pred is a learned label, or und (score 0) if the text is null, empty or without letters, or nothing could be learned.
    Of labels with equal posteriors the first by code point is predicted. Whole texts are read, however long; rows that repeat are
    predicted alike; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        tagger = Tagger(crf)
        for ids, out, texts in chunks(batches, 2, max_chars=4_000_000):
            labels, scores = tagger.predict(texts)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, crf: Crf) -> DataFrame:
    """docs(doc_id, text, ...) to one row each: doc_id, labels (the language of each word, of code-switched texts too) and
    posteriors (of these labels); words are what stands between ASCII blanks.

    A word without letters is und at posterior 0. Null and empty texts, or nothing learned, give empty lists or und alone; of
    equal posteriors the first label by code point holds. Long texts, repeats, empty tables and other columns are as in identify().
    """

    def run(batches):
        tagger = Tagger(crf)
        for ids, texts in chunks(batches, 1):
            split = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
            which = [i for i, w in enumerate(split) if w and crf.labels]
            labels, posteriors = [[UNKNOWN] * len(w) for w in split], [[0.0] * len(w) for w in split]
            if which:
                p, lengths, lettered = tagger.word_posteriors([split[i] for i in which])
                names = np.where(lettered, np.array(crf.labels, object)[p.argmax(1)], UNKNOWN)
                best, ends = np.where(lettered, p.max(1), 0).astype(float), np.cumsum(lengths)
                for i, a, b in zip(which, (ends - lengths).tolist(), ends.tolist(), strict=True):
                    labels[i], posteriors[i] = names[a:b].tolist(), best[a:b].tolist()
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(labels, pa.list_(pa.string())), pa.array(posteriors, pa.list_(pa.float64()))], ["doc_id", "labels", "posteriors"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, labels array<string>, posteriors array<double>")
