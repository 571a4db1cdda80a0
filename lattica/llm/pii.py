"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

The base patterns always hold. The model, trained in numpy on labelled spans, tags characters (outside, or the beginning
or inside of a kind) and adds spans in writings that the patterns miss, such as phone numbers without a plus. Each kind of span has
a digit or an @, so only the words around these are decoded: elsewhere no span could stand. Windows overlap; each
character takes its tag from the window in which it stands most centrally, and spans are read off the whole text.
"""

from __future__ import annotations

import hashlib
import random
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .language import held_out, one_each

#: The kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, MARGIN = 96, 48, 24

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits is either matched from its first digit or not at all, hence the look behind.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+")
_DIGIT = re.compile(r"[0-9]")
_BLANK = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: int, text: str) -> bool:
    """Whether a matched text passes the contract's condition on its kind."""
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in text.split("."))
    digits = "".join(c for c in text if "0" <= c <= "9")
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: an @ takes all that it can before it, so each @ is tried once, in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and _LOCAL.match(text, begin - 1):
            begin -= 1
        end = _DOMAIN.match(text, at + 1) if begin < at else None
        if end:
            out.append((begin, end.end()))
            free = end.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, by start and kind; ends are exclusive, units are code points."""
    found = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if valid(kind, m.group())]
    return sorted(found, key=lambda s: (s[0], s[2]))


# -- the model ---------------------------------------------------------------------------------------------------------

#: Character classes: 1 digit, 2 lower, 3 upper, then single characters, other ASCII, and the rest. 0 is padding.
_SINGLE = " \n@.-+()_%:/=,#*"
CLASSES = 4 + len(_SINGLE) + 2
TAGS = 1 + 2 * len(KINDS)


def _class_table() -> np.ndarray:
    table = np.full(128, CLASSES - 2, np.int64)
    for low, high, c in (("0", "9", 1), ("a", "z", 2), ("A", "Z", 3)):
        table[ord(low) : ord(high) + 1] = c
    for i, c in enumerate(_SINGLE):
        table[ord(c)] = 4 + i
    return table


_TABLE = _class_table()


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], CLASSES - 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstmCrf:
    """Tags windows of character classes. Parameters are a dict of arrays; both directions are alike but for the order."""

    def __init__(self, hidden: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        n = lambda *s: rng.normal(0, 0.3 / np.sqrt(s[0] if len(s) > 1 else 1), s).astype(np.float32)
        self.p = {}
        for d in "fb":
            # An embedding and the input weights in one: what a class adds to the four gates.
            self.p |= {f"x{d}": n(CLASSES, 4 * hidden) * 2, f"u{d}": n(hidden, 4 * hidden)}
            self.p[f"x{d}"][:, hidden : 2 * hidden] += 1.0  # forget gates begin open
        self.p |= {"w": n(2 * hidden, TAGS), "b": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32), "s": np.zeros(TAGS, np.float32)}
        self.forbid = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            self.forbid[:, 2 + 2 * k] = -1e4
            self.forbid[1 + 2 * k, 2 + 2 * k] = self.forbid[2 + 2 * k, 2 + 2 * k] = 0
        self.forbid_start = np.where(np.arange(TAGS) % 2 == 0, -1e4, 0).astype(np.float32)
        self.forbid_start[0] = 0

    def _direction(self, d: str, x: np.ndarray, keep: bool = False):
        """Hidden states (steps x windows x hidden) for classes x (steps x windows)."""
        h, steps, batch = self.hidden, *x.shape
        u, add = self.p[f"u{d}"], self.p[f"x{d}"]
        hs, cs = np.zeros((steps + 1, batch, h), np.float32), np.zeros((steps + 1, batch, h), np.float32)
        gates = np.empty((steps, batch, 4 * h), np.float32) if keep else None
        for t in range(steps):
            z = add[x[t]] + hs[t] @ u
            z[:, : 3 * h] = _sigmoid(z[:, : 3 * h])
            z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            cs[t + 1] = z[:, h : 2 * h] * cs[t] + z[:, :h] * z[:, 3 * h :]
            hs[t + 1] = z[:, 2 * h : 3 * h] * np.tanh(cs[t + 1])
            if keep:
                gates[t] = z
        return hs, cs, gates

    def _direction_back(self, d: str, x: np.ndarray, state, dh: np.ndarray, grads: dict) -> None:
        hs, cs, gates = state
        h, (steps, batch) = self.hidden, x.shape
        u = self.p[f"u{d}"]
        gu, gx = np.zeros_like(u), np.zeros_like(self.p[f"x{d}"])
        next_h, next_c = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, g = (gates[t][:, k * h : (k + 1) * h] for k in range(4))
            own, tc = dh[t] + next_h, np.tanh(cs[t + 1])
            dc = next_c + own * o * (1 - tc * tc)
            dz = np.concatenate((dc * g * i * (1 - i), dc * cs[t] * f * (1 - f), own * tc * o * (1 - o), dc * i * (1 - g * g)), 1)
            next_c, next_h = dc * f, dz @ u.T
            gu += hs[t].T @ dz
            np.add.at(gx, x[t], dz)
        grads[f"u{d}"], grads[f"x{d}"] = gu, gx

    @staticmethod
    def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each window the places of its own steps in reverse; padding stays where it is."""
        t = np.arange(x.shape[0])[:, None]
        return np.where(t < lengths[None, :], lengths[None, :] - 1 - t, t)

    def emissions(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        back, cols = self._turned(x, lengths), np.arange(x.shape[1])[None, :]
        f, b = self._direction("f", x, keep), self._direction("b", x[back, cols], keep)
        both = np.concatenate((f[0][1:], b[0][1:][back, cols]), 2)
        e = both @ self.p["w"] + self.p["b"]
        return (e, both, f, b, back, cols) if keep else e

    def _tables(self):
        return self.p["t"] + self.forbid, self.p["s"] + self.forbid_start

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi tags (steps x windows); what is past a window's length is meaningless."""
        e, (t, s) = self.emissions(x, lengths), self._tables()
        steps, batch, _ = e.shape
        score, back = e[0] + s, np.zeros(e.shape, np.int8)
        ends = np.zeros((batch, TAGS), np.float32)
        ends[lengths == 1] = score[lengths == 1]
        for k in range(1, steps):
            paths = score[:, :, None] + t[None]
            back[k] = paths.argmax(1)
            score = paths.max(1) + e[k]
            done = lengths == k + 1
            ends[done] = score[done]
        tags, now = np.zeros((steps, batch), np.int8), ends.argmax(1)
        for k in range(steps - 1, -1, -1):
            live = k < lengths
            tags[k, live] = now[live]
            now = np.where(live & (k > 0), back[k][np.arange(batch), now], now)
        return tags

    def loss_gradient(self, x: np.ndarray, gold: np.ndarray, lengths: np.ndarray) -> dict:
        """Gradient of the mean negative log-likelihood of gold tags (steps x windows)."""
        e, both, f, b, back, cols = self.emissions(x, lengths, keep=True)
        t, s = self._tables()
        steps, batch, _ = e.shape
        live = np.arange(steps)[:, None] < lengths[None, :]
        tt = np.exp(t)
        em = np.exp(e - e.max(2, keepdims=True))
        alpha, beta = np.empty_like(em), np.ones_like(em)
        alpha[0] = em[0] * np.exp(s)
        alpha[0] /= alpha[0].sum(1, keepdims=True)
        for k in range(1, steps):
            a = (alpha[k - 1] @ tt) * em[k]
            alpha[k] = a / a.sum(1, keepdims=True)
        pairs = np.zeros_like(tt)
        for k in range(steps - 2, -1, -1):
            ahead = em[k + 1] * beta[k + 1]
            new = ahead @ tt.T
            inner = live[k + 1]
            z = (alpha[k] * new).sum(1)
            pairs += tt * ((alpha[k] * (inner / z)[:, None]).T @ ahead)
            beta[k] = np.where(inner[:, None], new / new.sum(1, keepdims=True), 1)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        d = np.where(live[:, :, None], p, 0)
        k, w = np.nonzero(live)
        d[k, w, gold[k, w]] -= 1
        d = (d / batch).astype(np.float32)
        k, w = np.nonzero(live[1:])
        np.add.at(pairs, (gold[k, w], gold[k + 1, w]), -1)
        grads = {"t": (pairs / batch).astype(np.float32), "s": d[0].sum(0), "b": d.sum((0, 1)), "w": np.einsum("tbh,tbk->hk", both, d)}
        dh = d @ self.p["w"].T
        h = self.hidden
        self._direction_back("f", x, f, dh[:, :, :h], grads)
        self._direction_back("b", x[back, cols], b, dh[:, :, h:][back, cols], grads)
        return grads

    def fit(self, windows: list[np.ndarray], tags: list[np.ndarray], epochs: int = 14, batch: int = 48, rate: float = 0.02, seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        first, second, n = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                which = order[at : at + batch]
                x, lengths = padded([windows[i] for i in which])
                gold, _ = padded([tags[i] for i in which])
                grads = self.loss_gradient(x, gold, lengths)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                n += 1
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= rate * (1 - 0.8 * epoch / epochs) * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-6)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps x rows array, lengths)."""
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((int(lengths.max()), len(rows)), np.int64)
    for i, r in enumerate(rows):
        out[: len(r), i] = r
    return out, lengths


def areas_of(text: str) -> list[tuple[int, int]]:
    """Stretches around each digit and @: MARGIN characters, and on to the blanks that end the words there."""
    areas: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if areas and m.start() - MARGIN <= areas[-1][1]:
            a = areas.pop()[0]
        else:
            a = max(0, m.start() - MARGIN)
            floor = areas[-1][1] if areas else 0
            while a > floor and not text[a - 1].isspace():
                a -= 1
            if areas and a <= floor:
                a = areas.pop()[0]
        end = _BLANK.search(text, min(len(text), m.end() + MARGIN))
        areas.append([a, end.start() if end else len(text)])
    return [tuple(x) for x in areas]


def windows_of(text: str) -> list[tuple[int, int]]:
    """Overlapping windows of at most WINDOW characters that cover the text's areas."""
    out = []
    for a, b in areas_of(text):
        out.append((a, min(a + WINDOW, b)))
        while out[-1][1] < b:
            a += STRIDE
            out.append((a, min(a + WINDOW, b)))
    return out


def tagged(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(len(text), np.int64)
    for a, b, kind in reversed(spans):
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


def model_spans(texts: list[str], model: BiLstmCrf, batch: int = 256) -> list[list[tuple[int, int, int]]]:
    """Spans that the model finds in each text; see the module's text. No span has neither a digit nor an @.

    Takes four bytes for each character of a text's areas, besides one batch of windows.
    """
    out: list[list[tuple[int, int, int]]] = []
    areas = [areas_of(t) for t in texts]
    # For each text, its areas one after the other: how centrally a character stood at best, and the tag it got there.
    central = [np.full(sum(b - a for a, b in own), -1, np.int16) for own in areas]
    tags = [np.zeros(len(c), np.int8) for c in central]

    def windows():
        for i, own in enumerate(areas):
            begin = 0
            for a, b in own:
                at = a
                while True:
                    yield i, at, min(at + WINDOW, b), begin + at - a
                    if at + WINDOW >= b:
                        break
                    at += STRIDE
                begin += b - a

    jobs = windows()
    while part := list(islice(jobs, batch)):
        x, lengths = padded([classes_of(texts[i][a:b]) for i, a, b, _ in part])
        found = model.decode(x, lengths)
        for w, (i, a, b, at) in enumerate(part):
            k = np.arange(b - a)
            # The text's own ends cut nothing off, so they don't count as a window's edge.
            own = np.minimum(k if a else WINDOW + 0 * k, b - a - 1 - k if b < len(texts[i]) else WINDOW)
            better = own > central[i][at : at + b - a]
            central[i][at : at + b - a][better] = own[better]
            tags[i][at : at + b - a][better] = found[: b - a, w][better]
    for own, tag in zip(areas, tags, strict=True):
        spans, begin = [], 0
        for a, b in own:
            t = tag[begin : begin + b - a]
            begin += b - a
            for s in np.flatnonzero(t).tolist():
                kind = (int(t[s]) - 1) // 2
                # An inside tag continues the span that ends here; anything else begins one.
                if spans and spans[-1][1] == a + s and spans[-1][2] == kind and t[s] == 2 + 2 * kind:
                    spans[-1] = (spans[-1][0], a + s + 1, kind)
                else:
                    spans.append((a + s, a + s + 1, kind))
        out.append(spans)
    return out


def added_spans(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the model's spans that touch no base span and whose content has what its kind needs."""
    out, ends = [], [(a, b) for a, b, _ in base]
    for a, b, kind in found:
        own = text[a:b]
        if any(a < y and x < b for x, y in ends):
            continue
        fine = ("@" in own and "." in own) if kind == 0 else own.count(".") == 3 and valid(1, own.replace(" ", "")) if kind == 1 and re.fullmatch(r"[0-9. ]+", own) else kind > 1 and bool(re.fullmatch(r"[-0-9().+ ]+", own)) and valid(kind, own)
        if fine:
            out.append((a, b, kind))
    return out


# -- training ----------------------------------------------------------------------------------------------------------


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random) -> str:
    body = _digits(rng, 15)
    return next(body + c for c in "0123456789" if luhn(body + c))


def synthetic(rng: random.Random, letters) -> tuple[str, int]:
    """A written datum and its kind; kind -1: not personal, though it has digits or an @."""
    d = lambda n: _digits(rng, n)
    kind = rng.choice((0, 0, 1, 2, 2, 3, 3, 3, 3, -1, -1, -1, -1, -1))
    if kind == 0:
        dot, at = rng.choice((".", ".", ".", " . ")), rng.choice(("@", "@", " @ "))
        return f"{letters()}{rng.choice(('.', '_', ''))}{d(rng.choice((0, 2)))}{at}{letters()}{d(rng.choice((0, 1)))}{dot}{rng.choice(('com', 'org', 'net', 'de'))}", 0
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4)), 1
    if kind == 2:
        c = _card(rng)
        return rng.choice((c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4)))), 2
    if kind == 3:
        a, b, c = d(3), d(3), d(4)
        return rng.choice((f"+{d(1)} ({a}) {b}-{c}", f"+{d(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d(2)}{a}{b}{c}")), 3
    return rng.choice((f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"version {d(1)}.{d(1)}", d(rng.randint(1, 6)), f"{d(3)},{d(3)}", f"password={letters()}{d(5)}{letters()}{d(4)}", f"AKIA{letters().upper()}{d(3)}", f"{letters()}{d(2)}", f"@{letters()}", f"{d(1)}.{d(2)}", f"{letters()}{d(6)}{letters()}{d(7)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(11)}")), -1


def fit(texts: list[str], seed: int = 17, made: int = 700) -> BiLstmCrf:
    """Trains on the windows of texts, labelled by the base patterns, and on made windows of further writings."""
    rng = random.Random(seed)
    windows, tags, plain = [], [], []
    for text in texts:
        labels = tagged(text, base_spans(text))
        for a, b in windows_of(text):
            windows.append(classes_of(text[a:b]))
            tags.append(labels[a:b])
        plain += [w for w in text.split() if w.isalpha()]
    plain = plain[:: max(1, len(plain) // 5000)] or ["word", "text", "line"]
    letters = lambda: rng.choice(plain).lower()
    for _ in range(made):
        text, spans = " ".join(rng.choice(plain) for _ in range(rng.randint(0, 5))), []
        for _ in range(rng.choice((1, 1, 2))):
            datum, kind = synthetic(rng, letters)
            text += rng.choice((" ", " ", " ", ", ", ": ", "\n")) if text else ""
            if kind >= 0:
                spans.append((len(text), len(text) + len(datum), kind))
            text += datum + rng.choice((" ", " ", ". ", ", ", "")) + " ".join(rng.choice(plain) for _ in range(rng.randint(0, 4)))
        windows.append(classes_of(text[:WINDOW]))
        tags.append(tagged(text, spans)[:WINDOW])
    model = BiLstmCrf()
    model.fit(windows, tags)
    return model


def train(docs: DataFrame, most: int = 250, longest: int = 100_000) -> BiLstmCrf:
    """A model from at most `most` of the texts that have a digit or an @ and at most `longest` characters, of rows not held out."""
    rows = docs.where(~held_out() & F.col("text").isNotNull() & (F.length("text") <= longest)).where(F.col("text").rlike("[0-9@]"))
    slim = rows.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct()
    sample = one_each(rows.join(F.broadcast(slim), "doc_id", "left_semi").select("doc_id", "text"))
    return fit([r.text for r in sorted(sample, key=lambda r: (r.doc_id, r.text))])


def find(docs: DataFrame, model: BiLstmCrf) -> DataFrame:
    """docs(doc_id, text, ...) to one row each: doc_id, text, base and spans, both arrays of (start, end, kind) structs by
    start and kind. Null texts count as empty and have none; ends are exclusive, units are code points. Texts are read whole,
    however long; rows that repeat are read alike; of spans that begin together the kind listed first stands first; an empty
    table gives no rows; other columns are not read."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for ids, texts in chunks(batches, 1):
            base = [base_spans(t) if t else [] for t in texts]
            found = model_spans([t or "" for t in texts], model)
            every = [sorted(b + added_spans(t or "", b, f), key=lambda s: (s[0], s[2])) for t, b, f in zip(texts, base, found, strict=True)]
            named = lambda rows: [[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in r] for r in rows]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(named(base), span), pa.array(named(every), span)], ["doc_id", "text", "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "array<struct<start:long,end:long,kind:string>>"
    return rows.mapInArrow(run, f"doc_id long, text string, base {kind}, spans {kind}")


def digest(docs: DataFrame, model: BiLstmCrf) -> DataFrame:
    """find(), as counts and lists of places: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.
    Nulls, long texts, repeats, ties, empty tables and other columns are as there."""

    def run(batches):
        for ids, texts in chunks(batches, 1):
            found = model_spans([t or "" for t in texts], model)
            cols: list[list] = [[] for _ in range(7)]
            for t, f in zip(texts, found, strict=True):
                base = base_spans(t) if t else []
                more = added_spans(t or "", base, f)
                listed = lambda rows: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(rows, key=lambda s: (s[0], s[2])))
                for k in range(4):
                    cols[k].append(sum(s[2] == k for s in base))
                cols[4].append(hashlib.sha256(listed(base).encode()).hexdigest())
                cols[5].append(listed(base + more))
                cols[6].append(len(more))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
