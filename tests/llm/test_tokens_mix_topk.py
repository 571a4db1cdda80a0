import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import mixing, queries, topk, wavelet

from . import helpers


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5000) | st.sampled_from([7, 7, 7, 65535, 70000]), max_size=600))
def test_wavelet_matrix(values):
    ids = np.array(values, np.uint32)
    shard = wavelet.Shard.build([1], np.array([len(ids)]), ids)
    m = wavelet.Shard.from_bytes(shard.to_bytes()).matrix
    assert m.to_array().tolist() == values == m.access(np.arange(len(values))).tolist()
    for symbol in {*values[:5], 7, 4999, 1 << 20}:
        places = [k for k, x in enumerate(values) if x == symbol]
        assert m.count(symbol) == len(places) and m.occurrences(symbol).tolist() == places
        assert m.rank(symbol, len(values) // 2) == sum(p < len(values) // 2 for p in places)
        low, high = len(values) // 3, 2 * len(values) // 3
        assert m.occurrences(symbol, low, high).tolist() == [p for p in places if low <= p < high]
        if places:
            assert m.select(symbol, len(places) - 1) == places[-1]
        with pytest.raises(IndexError):
            m.select(symbol, len(places))


def test_shard_format():
    shard = wavelet.Shard.build([None, 5], np.array([2, 3]), np.array([9, 1, 4, 4, 1], np.uint32))
    again = wavelet.Shard.from_bytes(shard.to_bytes())
    assert again.doc_ids == [None, 5] and again.document(0).tolist() == [9, 1] and again.document(1).tolist() == [4, 4, 1]
    with pytest.raises(ValueError):
        wavelet.Shard.from_bytes(b"something else")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_word_encoder_on_odd_words():
    t, own = tokenizer(), wavelet.WordEncoder(queries.tokenizer_path(), limit=40)
    texts = ["It's don't WE'LL o'er", "<|endoftext|> a<|endoftext|>b, x.", "É é é ́a ΑΣ ΣΑΣ İstanbul ǅ", "123 4,5. $%& __a__ a_b", "　wide space\x85next", None, "", "Ünï, Word. word, WORD! (word)", "ﬁ ½ ﷺ 漢字かな 안녕"]
    for _ in range(2):
        lengths, ids = own.documents(texts)
        at = 0
        for text, n in zip(texts, lengths.tolist(), strict=True):
            assert ids[at : at + n].tolist() == t.encode(text or "", add_special_tokens=False).ids + [1], text
            at += n


def test_shards_against_tokenizer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = wavelet.encode_documents(docs, queries.tokenizer_path())
    assert sorted(map(tuple, got.collect())) == helpers.token_rows(rows, tokenizer())


def test_mix(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = con.sql(queries.OP4_SQL).df()
    got = queries.op4_systematic_mix(spark, sf_dir).toPandas()
    a, b = (x[sorted(x.columns)].sort_values("doc_id").reset_index(drop=True) for x in (got, expected))
    assert np.allclose(a.astype(float), b.astype(float), rtol=1e-9)
    assert (got.taken <= 2 * got["size"]).all()
    per = got.assign(source=got.source_size).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((per.taken - per.target).abs() <= 2 * per.most).all()
    again = queries.op4_systematic_mix(spark, sf_dir).toPandas()
    assert again.sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()


def test_targets_stop_and_reshare(spark):
    rows = [("a", 10), ("b", 1000), ("c", 1000), (None, 500), ("z", 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert sum(got.values()) == pytest.approx(1.5 * 2510) and got["a"] == 20 and got["z"] == 0
    assert all(got[s] <= 2 * n + 1e-9 for s, n in rows)
    # b, c and null weigh 2, 1 and 2; none is above its stop.
    assert got["b"] == pytest.approx(min(2000, (1.5 * 2510 - 20 - got[None] - got["c"])))


def test_bit_sliced_arithmetic():
    rng = np.random.default_rng(2)
    for n, dims, spread in ((1, 1, 3), (70, 5, 40), (200, 9, 1000), (64, 3, 1)):
        values = rng.integers(-spread, spread + 1, (n, dims))
        words = -(-n // 64)
        query = rng.integers(-spread, spread + 1, dims).tolist()
        slices, offset = topk.score_slices(topk.slices_of(values), query, words)
        got = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:n].astype(np.int64) << e for e, s in enumerate(slices)) - offset
        assert (np.zeros(n, np.int64) + got == values @ np.array(query)).all()
    assert all(sum(s << e for e, s in topk.signed_digits(q)) == q for q in range(-300, 300))


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for k in range(160)]
    rows += [(200, None), (201, [None] * 6), (250, [float("nan")] * 6), (251, []), (300, [1.0, 2.0]), (7, rows[7][1]), (None, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string")
    got = {}
    for r in topk.top_k(df, block_rows=40, block_queries=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    # Rows that repeat are candidates like any others.
    vectors = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in [*rows[:160], (7, rows[7][1])]]
    expected = {}
    for q in (0, 50, 100, 150):
        best = sorted((-sum(a * b for a, b in zip(vectors[q][1], v, strict=True)), i) for i, v in vectors if i != q)[:5]
        expected[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == expected
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_sends_a_block_of_candidates_once(spark):
    """Blocks of queries stream behind a block of candidates; a join would copy the block for each of them."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-300, 300, (150, 6)) / 256
    found = topk.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), every=5, block_rows=50, least_rows=10, block_queries=3)
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[-1]
    assert plan.split("\n")[1].strip(" :+-").startswith("Sort") and "Join" not in plan.split("Union")[0]
    whole = np.floor(256 * vectors).astype(np.int64)
    scores = whole @ whole.T
    expected = {(q, r + 1, c, int(scores[q, c])) for q in range(0, 150, 5) for r, c in enumerate(sorted((c for c in range(150) if c != q), key=lambda c: (-scores[q, c], c))[:5])}
    assert {tuple(r) for r in found.collect()} == expected


def test_top_k_rows_against_sql(spark):
    """Repeated rows, also of queries, unequal lengths, components up to 1e300 and scores beyond a long."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for k in range(120)]
    rows += [(50, rows[50][1]), (1, rows[1][1]), (1, rows[1][1]), (2, rows[3][1]), (100, [1e30, -1e30, 1e7, 2e7, 3e30, 1.0]), (60, [1e30] * 6), (61, [-1e300] * 6)]
    rows += [(150, [1.0, 2.0]), (151, [1.5, 2.0]), (200, None), (201, [None] * 6), (250, [float("nan")] * 6), (251, []), (None, rows[3][1]), (99, [1e7] * 6), (100, [1e7] * 6)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=40, block_queries=2).collect()
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float64()))}))
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.OP10_SQL).fetchall())


def test_word_encoder_on_every_letter():
    """Letters whose lower case or composition isn't all letters must not be taken apart from the punctuation that follows."""
    t, own = tokenizer(), wavelet.WordEncoder(queries.tokenizer_path())
    assert own.by_word
    odd = [chr(c) for c in range(0x110000) if chr(c).isalpha() and not unicodedata.normalize("NFC", chr(c)).lower().isalpha()]
    assert "\u0130" in odd and "\u0958" in odd
    texts = [form.format(c) for c in [*odd, *map(chr, range(0xC0, 0x250))] for form in ("{}@", "a{}.", "{0}{0}! x")]
    lengths, ids = own.documents(texts)
    told = [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]
    assert lengths.tolist() == list(map(len, told)) and ids.tolist() == [i for x in told for i in x]


def test_other_tokenizers_encode_whole_texts():
    own = wavelet.WordEncoder(queries.tokenizer_path("byte_bpe_50k.json"))
    told = own.tokenizer.encode("Some words, and more.  Words!", add_special_tokens=False).ids
    lengths, ids = own.documents(["Some words, and more.  Words!", None])
    assert not own.by_word and ids.tolist() == [*told, 1, 1] and lengths.tolist() == [len(told) + 1, 1]


def test_access_opens_single_chunks():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40_000, 200_000).astype(np.uint32)
    shard = wavelet.Shard.from_bytes(wavelet.Shard.build([1], np.array([len(ids)]), ids).to_bytes())
    m = shard.matrix
    assert m.access(150_000) == ids[150_000] and all(len(p._open) == 1 for p in m.planes)
    assert m.occurrences(int(ids[7])).tolist() == np.flatnonzero(ids == ids[7]).tolist()
    assert (m.to_array() == ids).all()


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(k, f"s{k % 3}", k, "mine", 7, "r", "a") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, target string, copies long, _row string, _at string")
    got = mixing.systematic_copies(df).collect()
    assert len(got) == 40 and all(r["_row"] == "r" and r["_at"] == "a" and isinstance(r.target, float) and 0 <= r.copies <= 2 for r in got)
    assert mixing.systematic_copies(df.limit(0)).count() == 0


def test_occurrences_from_the_files(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wavelet.write_shards(docs, f"file://{tmp_path}/tokens", queries.tokenizer_path(), shard_tokens=5000)
    shards = wavelet.read_shards(spark, f"file://{tmp_path}/tokens")
    every = [(r.doc_id, r.start + k, x) for r in wavelet.documents_of(shards, with_ids=True).collect() for k, x in enumerate(r.ids)]
    for symbol in (1, every[5][2], 1 << 20):
        expected = sorted((i, at) for i, at, x in every if x == symbol)
        assert sorted(map(tuple, wavelet.occurrences(shards, symbol).collect())) == expected
        counts = {}
        for i, _ in expected:
            counts[i] = counts.get(i, 0) + 1
        assert {r.doc_id: r.n for r in wavelet.occurrences(shards, symbol, places=False).collect()} == counts


def test_word_encoder_learns_letters_and_punctuation_once():
    """Forms of a word share its letters' ids; those of plain letters come from a tokenizer without normalizer and pattern."""
    t, own = tokenizer(), wavelet.WordEncoder(queries.tokenizer_path())
    words = [f"{a}{b}ße" for a in "abcdefghijklmnopqrst" for b in "éñüklmnopq"]
    ends = ["", *(x + y for x in ".,!?;" for y in ["", "*", ")"])]
    texts = [" ".join(form(w) + e for w in words) for e in ends for form in (str.lower, str.title, str.upper)]
    lengths, ids = own.documents([*texts, *own.LETTERS])
    told = [t.encode(x, add_special_tokens=False).ids + [1] for x in [*texts, *own.LETTERS]]
    assert lengths.tolist() == list(map(len, told)) and ids.tolist() == [i for x in told for i in x]
    # Upper case of the sharp s is other letters.
    assert own.used <= 2 + 2 * len(words) + len(ends) + len(own.LETTERS)
