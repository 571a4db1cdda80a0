"""Awkward and empty tables through every operator and stage."""

import pytest

import corpus_pipeline
from lattica.llm import decontaminate, language, lines, mixing, passages, pii, queries, simhash, toxicity, wavelet

from . import helpers


@pytest.fixture(scope="module")
def tables(spark):
    docs = helpers.frame(spark, helpers.odd_rows())
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, 0, None), (9, None, None), (None, 1, 1), (12, 0, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "the alpha of the beta gamma delta epsilon zeta"), (2, None), (None, "x y z"), (3, ""), (4, "été déjà vu")], "item_id long, text string")
    return docs, labels, benchmark


def operators(docs, labels, benchmark):
    return {
        "language": lambda: language.identify(docs, language.train(docs)),
        "simhash": lambda: simhash.near_duplicates(docs),
        "tokens": lambda: wavelet.encode_documents(docs, queries.tokenizer_path()),
        "mixing": lambda: mixing.systematic_copies(mixing.sized(docs.select("doc_id", "text", "source"))),
        "passages": lambda: passages.dedup_passages(docs),
        "pii": lambda: pii.digest(docs, pii.train(docs)),
        "lines": lambda: lines.dedup_lines(docs),
        "toxicity": lambda: toxicity.score(docs, toxicity.train(docs, labels)),
        "find": lambda: decontaminate.find(docs, decontaminate.prepare(docs, benchmark)),
    }


NAMES = sorted(operators(None, None, None))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(tables, name):
    rows = operators(*tables)[name]().collect()
    if name != "find":
        assert len(rows) == len(helpers.odd_rows())


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(tables, name):
    docs, labels, benchmark = tables
    assert operators(docs.limit(0), labels.limit(0), benchmark.limit(0))[name]().count() == 0


def test_odd_results(tables):
    docs, _, benchmark = tables
    rows = [r for r in helpers.odd_rows() if r[0] is not None]
    prints = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert prints[2].fp == prints[3].fp == prints[4].fp == 0 and prints[3].component_id == 2 and prints[6].component_id == 5
    assert prints[7].component_id == prints[8].component_id == 7 and prints[None].component_id is None
    distinct = list({r[0]: (r[0], r[1]) for r in rows}.values())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.dedup_passages(docs.where("doc_id IS NOT NULL")).collect()}
    assert got == helpers.passages(distinct)
    got = {r.doc_id: list(r.removed) for r in lines.dedup_lines(docs.where("doc_id IS NOT NULL")).collect()}
    assert got == helpers.lines(distinct)
    langs = {r.doc_id: r.lang_pred for r in language.identify(docs, language.train(docs)).collect()}
    assert langs[2] == langs[3] == langs[4] == langs[13] == "und" and langs[5] != "und"
    spans = {r.doc_id: r for r in pii.digest(docs, pii.train(docs)).collect()}
    assert (spans[12].n_phone, spans[12].n_card, spans[12].n_ip) == (1, 1, 1) and spans[1].n_email == 1 and spans[2].spans == ""
    found = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, decontaminate.prepare(docs, benchmark)).collect()}
    assert (14, 4) in found


def test_filters_keep_columns(tables):
    docs, labels, benchmark = tables
    for out in (toxicity.keep_clean(docs, toxicity.train(docs, labels)), simhash.keep_representatives(docs), decontaminate.keep_clean(docs, decontaminate.prepare(docs, benchmark)), mixing.mixed(docs)):
        assert out.columns == docs.columns
        out.collect()
    kept = {r.doc_id for r in simhash.keep_representatives(docs).collect()}
    assert kept == {None, 1, 2, 5, 7, 9, 10, 11, 12, 13, 14, 15}


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = step(spark, docs, sf_dir)
        kept[name] = after = docs.collect()
        if name == "simhash_near_dedup":
            roots = helpers.jaccard_roots([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == set(roots.values())
        if name == "source_mixing":
            copies = {}
            for r in after:
                copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
            assert max(copies.values()) <= 2 and set(after) <= set(before)
        if name == "token_output":
            from tests.llm.test_tokens_mix_topk import tokenizer

            expected = helpers.token_rows(sorted((r.doc_id, r.text) for r in before), tokenizer())
            assert sorted(map(tuple, after)) == sorted(expected)
        else:
            docs = spark.createDataFrame(after, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    assert len(kept["toxicity"]) >= len(kept["simhash_near_dedup"]) >= len(kept["benchmark_decontamination"]) > 0


def test_pipeline_on_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
