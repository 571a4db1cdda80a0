"""Brute-force versions of the text operators, and awkward tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, fp string, w array<int>, _row string, copies long"


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long_text = " ".join(f"word{k % 977} und das" for k in range(8000)) + "\n" + "x" * 50_000
    passage = " ".join(f"passage{k}" for k in range(30))
    texts = [
        (1, "One line here that is rather short.\nAnd another one, with mail bob.1@example.com inside."),
        (2, None), (3, ""), (4, " \t\n\x0b "), (5, long_text), (6, long_text), (6, long_text),
        (7, "alpha beta"), (8, "Alpha BETA"), (9, f"before it {passage} after it"), (10, f"{passage} and then {passage}"),
        (11, "same " * 60), (12, "One line here that is rather short.\nCall +1 (555) 123-4567 or 4111 1111 1111 1111 from 10.0.0.1."),
        (None, "a text without an id, of which nothing is known"), (13, "123 456 !!! ..."), (14, "été déjà vu, où ça\r\nété"), (15, "\U0001f600 emoji   nbsp em"),
    ]
    sources = ["b", "a", None, "b", "a", "c"]
    return [(i, t, [None, "en", "de"][k % 3], sources[k % 6], None, 5, "t", None, None, "r", 3) for k, (i, t) in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return WORD.findall(text) if text else []


def fingerprint(text, width=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text)) if text else []
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_roots(rows):
    """Components of the links at 5-word Jaccard 0.8 or more, by brute force."""
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) else frozenset() for i, t in rows}
    having = {}
    for i, s in sets.items():
        for x in s or [None]:
            having.setdefault(x, []).append(i)
    pairs = {(a, b) for own in having.values() for a in own for b in own if a < b}
    return components([(a, b) for a, b in pairs if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))], sets)


def passages(docs, size=20):
    """docs: (doc_id, text) in order, ids distinct. doc_id to (n_words, n_removed, kept_sha256)."""
    seen, out = set(), {}
    for i, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone[s : s + size] = [True] * size
            seen.add(key)
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def lines(docs):
    """docs: (doc_id, text) in order, ids distinct. doc_id to the numbers of the removed lines."""
    having, sets, out = {}, [], {}
    for i, text in docs:
        out[i] = []
        for k, line in enumerate(text.split("\n") if text is not None else []):
            s = frozenset(words(line))
            if not s:
                continue
            common = Counter(j for w in s for j in having.get(w, ()))
            if any(9 * n >= 4 * (len(s) + len(sets[j])) for j, n in common.items()):
                out[i].append(k)
            for w in s:
                having.setdefault(w, []).append(len(sets))
            sets.append(s)
    return out


def token_rows(docs, tokenizer):
    """docs: (doc_id, text) in order: (doc_id, start, n_tokens, ids_crc32)."""
    at, out = 0, []
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out
