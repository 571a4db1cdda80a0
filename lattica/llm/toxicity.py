"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A word's embedding is the sum of those of its hashed lower-cased letters and of its hashed beginnings, so that inflected
forms of a stem share a part. Filters slide over the words of the whole text; the largest response of each, after a
rectifier, goes to a logistic output. The thresholds are calibrated by language on all labelled texts that weren't fitted,
at the class shares of all labelled texts; the language is itself guessed from the words, and the score is shifted so that
one threshold (0.3) holds for all.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_join, stage, trim
from .language import held_out, one_each, sample_by_label

BUCKETS = 1 << 15
PREFIXES = (4, 5, 6, 8)
WIDTHS = (1, 2, 3)
#: Empty words after each text: a filter over empty words alone counts, one that reaches the next text never does.
PAD = 2 * (max(WIDTHS) - 1)
THRESHOLD = 0.3
#: What isn't a letter, but for the newline between words.
_OTHERS = re.compile(r"[^\w\n]+|[\d_]+")
#: Steps of a logit in the counts that thresholds are set from.
STEP = 1024


def buckets_of(words: list[bytes]) -> np.ndarray:
    """For each word (without blanks) 1 + len(PREFIXES) bucket numbers: of its lower-cased letters and of their beginnings of so
    many bytes (0, the empty bucket, for none)."""
    letters = _OTHERS.sub("", b"\n".join(words).decode("utf-8", "replace").lower()).encode()
    data = np.frombuffer(letters + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    sizes = np.diff(ends, prepend=-1) - 1
    starts = ends - sizes
    power = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, 0x01000193, np.uint32), dtype=np.uint32)
    value = (data + np.uint32(1)) * power[np.arange(len(data)) - np.repeat(starts, sizes + 1)]
    value[ends] = 0
    hashes, sums = [np.add.reduceat(value, starts, dtype=np.uint32)], np.zeros(len(words), np.uint32)
    out = np.zeros((len(words), 1 + len(PREFIXES)), np.int64)
    for j in range(max(PREFIXES)):
        sums = sums + np.where(sizes > j, value[np.minimum(starts + j, len(value) - 1)], 0).astype(np.uint32)
        if j + 1 in PREFIXES:
            hashes.append(sums)
    for k, (h, least) in enumerate(zip(hashes, (1, *PREFIXES), strict=True)):
        h = (h ^ np.uint32(0x9E3779B1 * (k + 1) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        out[:, k] = np.where(sizes >= least, 1 + (h ^ h >> np.uint32(16)) % np.uint32(BUCKETS - 1), 0)
    return out


class TextCnn:
    """Parameters and their fit; all in float32."""

    def __init__(self, dims: int = 12, filters: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.dims, self.filters = dims, filters
        self.embedding = rng.normal(0, 0.1, (BUCKETS, dims)).astype(np.float32)
        self.embedding[0] = 0
        self.conv = [rng.normal(0, 0.5 / np.sqrt(k), (k, dims, filters)).astype(np.float32) for k in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * filters, np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * filters).astype(np.float32)
        self.out_bias = np.float32(-2)
        self.languages: list[str] = []
        self.language_weights = np.zeros((BUCKETS, 0), np.float32)
        self.shift = np.zeros(1, np.float32)

    def _pool(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """(pooled responses, position of each) over embedded words x, padded by PAD empty words a text."""
        n = len(x)
        owner = np.repeat(np.arange(len(starts)), lengths)
        pooled, places = [], []
        for k, w in zip(WIDTHS, self.conv, strict=True):
            r = np.zeros((n, self.filters), np.float32)
            for j in range(k):
                r[: n - j] += x[j:] @ w[j]
            for j in range(1, k):
                r[starts + lengths - j] = -np.inf
            best = np.maximum.reduceat(r, starts, axis=0)
            hit = r == best[owner]
            at = np.stack([np.minimum.reduceat(np.where(hit[:, f], np.arange(n), n), starts) for f in range(self.filters)], 1)
            pooled.append(best)
            places.append(at)
        return np.concatenate(pooled, 1), np.concatenate(places, 1)

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 5) -> None:
        """texts: bucket numbers (words x features), each ending in PAD empty words; labels 0 or 1."""
        rng = np.random.default_rng(seed)
        params = [self.embedding, *self.conv, self.bias, self.out]
        first, second, t, ob = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, np.zeros(2)
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3)).astype(np.float32)
        for epoch in range(epochs):
            lr = rate * (1 - 0.9 * epoch / epochs)
            order = rng.permutation(len(texts))
            for b in range(0, len(order), batch):
                which = order[b : b + batch]
                ids = np.concatenate([texts[i] for i in which])
                lengths = np.array([len(texts[i]) for i in which])
                starts = np.cumsum(lengths) - lengths
                x = self.embedding[ids].sum(1)
                pooled, places = self._pool(x, starts, lengths)
                h = np.maximum(pooled + self.bias, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30)))
                d = (p - labels[which]) * weight[which] / len(which)
                dh = d[:, None] * self.out[None, :] * (h > 0)
                grads = [np.zeros_like(self.embedding)]
                rows, values = [], []
                for i, (k, w) in enumerate(zip(WIDTHS, self.conv, strict=True)):
                    own = slice(i * self.filters, (i + 1) * self.filters)
                    at, g = places[:, own], dh[:, own]
                    gw = np.zeros_like(w)
                    for j in range(k):
                        xs = x[np.minimum(at + j, len(x) - 1)]
                        gw[j] = np.einsum("df,dfe->ef", g, xs)
                        rows.append(np.minimum(at + j, len(x) - 1).ravel())
                        values.append((g[:, :, None] * w[j].T[None]).reshape(-1, self.dims))
                    grads.append(gw)
                rows, values = np.concatenate(rows), np.concatenate(values)
                used = np.abs(values).sum(1) > 0
                for column in range(ids.shape[1]):
                    np.add.at(grads[0], ids[rows[used], column], values[used])
                grads[0][0] = 0
                grads += [dh.sum(0), h.T @ d]
                t += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.99
                    v += 0.01 * g * g
                    q -= lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
                ob = ob * [0.9, 0.99] + [0.1 * d.sum(), 0.01 * d.sum() ** 2]
                self.out_bias -= np.float32(lr * ob[0] / (np.sqrt(ob[1]) + 1e-6))

    def fit_languages(self, texts: list[np.ndarray], labels: list[str], seed_weight: float = 0.5) -> None:
        """Log odds of the words' own buckets by language, for the guess that picks a calibration."""
        self.languages = sorted(set(labels))
        counts = np.full((BUCKETS, len(self.languages)), seed_weight, np.float64)
        for ids, label in zip(texts, labels, strict=True):
            np.add.at(counts[:, self.languages.index(label)], ids[:, 0], 1)
        share = counts / counts.sum(0)
        self.language_weights = np.log(share / share.mean(1, keepdims=True)).astype(np.float32)
        self.language_weights[0] = 0
        self.shift = np.zeros(max(1, len(self.languages)), np.float32)

    def calibrate(self, counts: dict, least: int = 12) -> None:
        """counts: (guessed language, label) to {step of the logit: (fitted, other)}, the numbers of texts by step (see STEP).

        For each language the cut with the best F1, halfway to the next step that has texts. Where fewer than least
        toxic texts weren't fitted, the other languages' texts make up for the missing ones, at that weight. Fitted texts
        only count in their class's share: the others of the class stand for them, so that the shares are those of all
        texts. Where no toxic text is left unfitted, fitted ones are used.
        """

        def cut(shares):
            at, weights = {}, {}
            for y in (0, 1):
                for i, share in shares.items():
                    own = counts.get((i, y), {})
                    total, other = (sum(map(f, own.values())) for f in (sum, lambda n: n[1]))
                    if other:
                        weights[i, y] = share * total / other
                    for z, n in own.items():
                        if n[1]:
                            at.setdefault(z, [0.0, 0.0])[y] += n[1] * weights[i, y]
            z = sorted(at, reverse=True)
            n = np.array([at[x] for x in z]).reshape(-1, 2).cumsum(0)
            if not len(z) or n[-1, 0] == 0 or n[-1, 1] == 0:
                return None
            f1 = 2 * n[:, 1] / (n.sum(1) + n[-1, 1])
            best = int(np.flatnonzero(f1 >= f1.max() - 1e-9)[-1])
            below = z[best + 1] if best + 1 < len(z) else z[best] - 2 * STEP
            return (z[best] + below) / 2 / STEP

        if not any(n[1] for (_, y), own in counts.items() if y for n in own.values()):
            counts = {key: {z: (0, sum(n)) for z, n in own.items()} for key, own in counts.items()}
        every = range(len(self.shift))
        base = np.log(THRESHOLD / (1 - THRESHOLD))
        known = {i: sum(n[1] for n in counts.get((i, 1), {}).values()) for i in every}
        toxic = {i: sum(map(sum, counts.get((i, 1), {}).values())) if known[i] else 0 for i in every}
        for i in every:
            rest = sum(toxic.values()) - toxic[i]
            others = min(1.0, max(0, least - known[i]) / rest) if rest else 0
            c = cut({j: 1.0 if j == i else others for j in every if j == i or others})
            self.shift[i] = base - c if c is not None else 0


class Scorer:
    """Applies a classifier; keeps for up to limit words what each adds to the filters at each of their places."""

    def __init__(self, cnn: TextCnn, limit: int = 60_000):
        self.cnn, self.limit = cnn, limit
        # Filters are linear before pooling, so each bucket's contribution is known beforehand.
        self.flat = np.concatenate([cnn.conv[i][j] for i, k in enumerate(WIDTHS) for j in range(k)], axis=1)
        self._forget()

    def _forget(self) -> None:
        columns = self.flat.shape[1] + len(self.cnn.languages)
        self.places, self.table = {b"": 0}, np.zeros((1, columns), np.float32)

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(logit, language number) of each text; a text without words is one empty word."""
        pad = [b""] * PAD
        words, lengths = [], []
        for text in texts:
            own = (text.encode("utf-8", "replace").split() if text else []) + pad
            words += own
            lengths.append(len(own))
        new = set(words) - self.places.keys()
        if len(self.places) + len(new) > self.limit:
            self._forget()
            new = set(words) - self.places.keys()
        if new:
            ids = buckets_of(list(new))
            rows = self.cnn.embedding[ids].sum(1) @ self.flat
            rows = np.concatenate((rows, self.cnn.language_weights[ids[:, 0]]), 1)
            self.places.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate((self.table, rows.astype(np.float32)))
        place = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        lengths = np.array(lengths)
        starts = np.cumsum(lengths) - lengths
        f, column, pooled, n = self.cnn.filters, 0, [], len(place)
        for k in WIDTHS:
            r = self.table[place, column : column + f]
            for j in range(1, k):
                r[: n - j] += self.table[place[j:], column + j * f : column + (j + 1) * f]
            for j in range(1, k):
                r[starts + lengths - j] = -np.inf
            column += k * f
            pooled.append(np.maximum.reduceat(r, starts, axis=0))
        h = np.maximum(np.concatenate(pooled, 1) + self.cnn.bias, 0)
        z = h @ self.cnn.out + self.cnn.out_bias
        language = np.zeros(len(texts), np.int64)
        if self.cnn.languages:
            language = np.add.reduceat(self.table[place, column:], starts, axis=0).argmax(1)
        return z.astype(np.float64), language

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z, language = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(z + self.cnn.shift[language], -40, 40)))


def encode(text: str) -> np.ndarray:
    words = text.encode("utf-8", "replace").split()
    pad = np.zeros((PAD, 1 + len(PREFIXES)), np.int64)
    return np.concatenate((buckets_of(words), pad)) if words else pad


def fit(sample: list) -> tuple[TextCnn, list]:
    """A classifier without thresholds from rows with doc_id, text, lang, toxic; and the ids of those it was fitted on."""
    sample = sorted(sample, key=lambda r: (zlib.crc32(f"o{r.doc_id}".encode()), r.doc_id, r.text or ""))
    cnn = TextCnn()
    texts = [encode(r.text or "") for r in sample]
    labels = np.array([r.toxic for r in sample], np.int64)
    kept = np.array([zlib.crc32(f"c{r.doc_id}".encode()) % 5 == 0 for r in sample], bool)
    if len(sample) == 0 or labels.min() == labels.max():
        return cnn, []
    known = [(x, r.lang) for x, r in zip(texts, sample, strict=True) if r.lang is not None]
    if known:
        cnn.fit_languages([x for x, _ in known], [y for _, y in known])
    fitted = np.flatnonzero(~kept) if (~kept).any() else np.arange(len(sample))
    cnn.fit([texts[i] for i in fitted], labels[fitted])
    return cnn, [sample[i].doc_id for i in fitted]


def logit_counts(rows: DataFrame, cnn: TextCnn, fitted: list) -> dict:
    """What calibrate() takes, from every row of rows(doc_id, text, toxic) in one distributed pass."""
    ids = np.sort(np.array(fitted, np.int64))

    def run(batches):
        scorer = Scorer(cnn)
        for own, toxic, texts in chunks(batches, 2, max_chars=600_000):
            z, language = scorer.logits(texts)
            z = np.floor(np.clip(z, -40, 40) * STEP).astype(np.int64)
            cols = [pa.array(language.astype(np.int32)), pa.array(toxic, pa.int32()), pa.array(z), pa.array(np.isin(np.array(own, np.int64), ids))]
            yield pa.record_batch(cols, ["language", "toxic", "z", "fitted"])
        del scorer
        trim()

    scored = rows.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), F.col("text").cast("string")).mapInArrow(run, "language int, toxic int, z long, fitted boolean")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts: dict = {}
    # Bounded by languages, labels and steps, whatever the number of rows.
    for r in scored.groupBy("language", "toxic", "z").agg(n(F.col("fitted")).alias("fitted"), n(~F.col("fitted")).alias("other")).collect():
        counts.setdefault((r.language, int(r.toxic > 0)), {})[r.z] = (r.fitted, r.other)
    return counts


def train(docs: DataFrame, labels: DataFrame, per_label: int = 900) -> TextCnn:
    """A classifier fitted on at most per_label labelled whole texts of each class; thresholds from all labelled rows. Rows that
    are held out take part in neither.

    labels(doc_id, toxic): null labels are left out; of several labels of one id the largest holds.
    """
    own = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("text").isNotNull())
    # The ids first, then the texts of the chosen alone.
    labelled = stage(rows.select("doc_id").join(own, "doc_id"), "labelled")
    chosen = sample_by_label(labelled, "toxic", per_label, ["doc_id", "toxic"])
    toxic = {r.doc_id: r.toxic for r in chosen}
    if not toxic:
        return TextCnn()
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in toxic], "doc_id long")
    found = one_each(rows.join(F.broadcast(ids), "doc_id", "left_semi"))

    class Row:
        def __init__(self, r):
            self.doc_id, self.text, self.lang, self.toxic = r.doc_id, r.text, r.lang, toxic[r.doc_id]

    cnn, fitted = fit([Row(r) for r in found])
    if fitted:
        cnn.calibrate(logit_counts(small_join(rows, own, ["doc_id"], max_rows=1_000_000), cnn, fitted))
    return cnn


def score(docs: DataFrame, cnn: TextCnn) -> DataFrame:
    """docs(doc_id, text, ...) to one row each: doc_id, held_out, score, predicted (1 if score >= 0.3).

    Null and empty texts are scored as one without words; repeated rows alike; other columns are not read.
    """

    def run(batches):
        scorer = Scorer(cnn)
        for ids, out, texts in chunks(batches, 2, max_chars=600_000):
            s = scorer.scores(texts)
            cols = [pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]
            yield pa.record_batch(cols, ["doc_id", "held_out", "score", "predicted"])
        del scorer
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, cnn: TextCnn) -> DataFrame:
    """The rows of docs whose text isn't predicted toxic; all columns unchanged, in one pass over the texts."""
    names = docs.columns

    def run(batches):
        scorer = Scorer(cnn)
        for batch in batches:
            flags = []
            for (texts,) in chunks(iter([batch.select(["text"])]), 0, max_chars=600_000):
                flags += (scorer.scores(texts) < THRESHOLD).tolist()
            yield batch.filter(pa.array(flags, pa.bool_()))
        del scorer
        trim()

    return docs.select(*names).mapInArrow(run, docs.schema)
