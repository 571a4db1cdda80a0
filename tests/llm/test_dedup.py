import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from lattica.llm import lines, near, passages, simhash
from lattica.llm.components import connected_components

from . import helpers


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    decode = simhash.golay_decoder()
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000).astype(np.uint64)
    b = a.copy()
    for _ in range(2):
        b ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    keys = []
    for x in (a, b):
        index, key = simhash.golay_keys(x.view(np.int64), decode)
        keys.append([set(key[index == k].tolist()) for k in range(3000)])
    assert all(x & y for x, y in zip(*keys, strict=True))
    assert max(map(len, keys[0])) <= 18
    # Every word is within three bits of its codeword, and codewords are 7 apart at least.
    v = rng.integers(0, 2**23, 2000)
    index = decode(v)
    assert (decode(v ^ 0) == index).all() and index.max() < 4096


def near_group(rng, n):
    base = rng.getrandbits(64)
    return [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(n)]


@pytest.mark.parametrize("limit", [2, 24])
def test_links_of_large_groups(spark, limit):
    """Groups over the pair limit give the same components as all pairs."""
    rng = random.Random(3)
    fps = sorted({f for _ in range(4) for f in near_group(rng, 60)} | {rng.getrandbits(64) for _ in range(100)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    expected = helpers.components([(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2], signed)
    got = {r.node: r.root for r in connected_components(simhash.near_links(df, 2, limit)).collect()}
    assert {n: got.get(n, n) for n in signed} == expected
    got = {r.node: r.root for r in connected_components(simhash.near_links(df, 1, limit)).collect()}
    expected = helpers.components([(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 1], signed)
    assert {n: got.get(n, n) for n in signed} == expected


def test_components_of_a_path_and_nothing(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in connected_components(path).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert connected_components(path.limit(0)).count() == 0


def test_simhash_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps = {r.doc_id: helpers.fingerprint(r.text) for r in docs.collect()}
    roots = helpers.components([(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2], fps)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint("fp").alias("fp"), "component_id").collect()
    assert {(r.doc_id, r.fp, r.component_id) for r in got} == {(i, f"{f:016x}", roots[i]) for i, f in fps.items()}
    kept = {r.doc_id for r in simhash.keep_representatives(docs).collect()}
    assert kept == set(roots.values())


def test_passages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    expected = helpers.passages([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.dedup_passages(docs).collect()}
    assert got == expected and sum(x[1] for x in expected.values()) > 0


def test_passages_of_random_repeats(spark):
    """Short alphabets, periods, and pieces of earlier texts."""
    rng = random.Random(5)
    texts = []
    for k in range(60):
        w = [rng.choice("ab") if k % 3 == 0 else rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 70))]
        if texts and rng.random() < 0.7:
            other = rng.choice(texts).split()
            a = rng.randint(0, len(other))
            w[rng.randint(0, len(w)) : 0] = other[a : a + rng.randint(0, 45)]
        if k % 7 == 0:
            w = w[: rng.randint(1, 9)] * 12
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == helpers.passages(rows)


def test_lines_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    expected = helpers.lines([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: list(r.removed) for r in lines.dedup_lines(docs).collect()} == expected


def test_lines_of_many_variants(spark):
    """Large groups of near copies, also where the earliest is similar to few of them."""
    rng = random.Random(9)
    rows = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(30)]
        for v in range(50):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(30)] = f"v{rng.randrange(40)}"
            rows.append((len(rows), " ".join(w) + "\n" + " ".join(rng.sample(base, 9))))
    got = {r.doc_id: list(r.removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == helpers.lines(rows)


def test_pipeline_near_duplicates_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    roots = helpers.jaccard_roots([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()} == set(roots.values())


def test_pipeline_near_duplicates_of_edited_copies(spark):
    """Chains and large groups of edited copies, a passage in many texts, short and empty texts."""
    rng = random.Random(4)
    common, rows = [f"c{k}" for k in range(12)], [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "a b c")]
    for g in range(6):
        w = [f"g{g}w{k}" for k in range(rng.randint(40, 200))] + common
        for v in range(30):
            rows.append((len(rows), " ".join(w)))
            own = list(w)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            w = own if g < 3 else w
            if g >= 3:
                rows.append((len(rows), " ".join(own)))
    expected = helpers.jaccard_roots(rows)
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert len(rows) > len(set(expected.values())) > 12


def class_links(docs):
    """doc_id to [(line, number of similar classes)] where classes with links first stand, by brute force."""
    place = {}
    for i, text in docs:
        for k, line in enumerate(text.split("\n") if text is not None else []):
            if helpers.words(line):
                place.setdefault(frozenset(helpers.words(line)), (i, k))
    counts, sets = {}, list(place)
    for k, a in enumerate(sets):
        for b in sets[k + 1 :]:
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                for x in (a, b):
                    counts[place[x]] = counts.get(place[x], 0) + 1
    out = {i: [] for i, _ in docs}
    for (i, k), n in sorted(counts.items()):
        out[i].append((k, n))
    return out


def test_line_links_against_brute_force(spark, sf_dir):
    """Each class has all its links, also in groups of three and more."""
    rng = random.Random(11)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    first = max(i for i, _ in rows) + 1
    for v in range(30):
        w = [f"w{k}" for k in range(30)]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(30)] = f"v{rng.randrange(40)}"
        rows.append((first + v, " ".join(w)))
    expected = class_links(rows)
    got = {r.doc_id: [(x.line, x.n) for x in r.links] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected and max(n for own in expected.values() for _, n in own) > 3


def test_lines_with_a_word_in_every_line(spark):
    """A word that all lines have, other blanks than spaces, and long lines."""
    rng = random.Random(21)
    rows = []
    for k in range(120):
        own = [f"x{rng.randrange(400)}" for _ in range(rng.choice((1, 3, 4, 5, 9, 150)))]
        rows.append((k, "the " + "\t".join(own) + "\n\x0b \n" + "\r".join(["the", *own[: -1 or None]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.dedup_lines(df).collect()
    assert {r.doc_id: list(r.removed) for r in got} == helpers.lines(rows)
    assert {r.doc_id: [(x.line, x.n) for x in r.links] for r in got} == class_links(rows)
    assert {r.n_lines for r in got} == {3}


def test_lines_of_large_families_without_their_pairs(spark, monkeypatch):
    """Edits of a line beyond and within reach of each other: all links are counted, and few are made as pairs."""
    made, stage = {}, lines.stage

    def counted(df, name):
        out = stage(df, name)
        if name in ("pairs", "near"):
            made[name] = out.count()
        if name == "families":
            made["edits"] = lines._edit_pairs(out, 4, 5).count()
        return out

    monkeypatch.setattr(lines, "stage", counted)
    rng = random.Random(31)
    rows = []
    for g in range(2):
        base = [f"g{g}w{k}" for k in range(60)]
        for v in range(250):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 6, 9))):
                w[rng.randrange(60)] = f"v{rng.randrange(90)}" if rng.random() < 0.5 else f"u{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**9), " ".join(w)))
    rows.sort()
    expected = class_links(rows)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [(x.line, x.n) for x in r.links] for r in got} == expected
    assert {r.doc_id: list(r.removed) for r in got} == helpers.lines(rows)
    links = sum(n for own in expected.values() for _, n in own) // 2
    assert links > 10_000 and sum(made.values()) < links / 4, (links, made)


def test_rarity_of_words_below_the_mean(spark):
    """Words that stand in few lines are told apart, and both sides of the join have only the words that they need."""
    text = "the " * 1_000_000 + "once " + "often " * 4
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    table = lines._shares(df)
    bucket = lambda w: spark.sql(f"SELECT shiftrightunsigned(xxhash64('{w}'), {64 - lines._BITS})").first()[0]
    once, often, the = (table[bucket(w)] for w in ("once", "often", "the"))
    assert often - once == 4 and the == 31
    classes = lines.line_classes(spark.createDataFrame([(k, " ".join(f"w{k + j}" for j in range(45))) for k in range(9)], "doc_id long, text string"), table)
    assert {len(r.prefix) for r in classes.collect()} == {10}
    assert lines._postings(classes, F.col("prefix")).count() == 90
    assert lines.candidate_pairs(classes).count() >= sum(1 for a in range(9) for b in range(a) if a - b <= 5)
