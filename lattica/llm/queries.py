"""The registered queries of the text operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, lines, mixing, passages, pii, simhash, topk, toxicity, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.sized(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size")
    rows = mixing.systematic_copies(docs)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP4_SQL = f"SELECT doc_id, size, source_size, target, copies * size AS taken FROM ({mixing.mixing_sql()})"


def op10_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(_table(spark, sf_dir, "embeddings"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP10_SQL = """
WITH v AS (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: floor(greatest(-9007199254740992, least(9007199254740992, 256 * x::DOUBLE)))::HUGEINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.u, q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.u <> c.u AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, greatest(-9223372036854775808, least(9223372036854775807, score))::BIGINT AS score FROM r WHERE rank <= 5"""


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op5_recurring_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup_passages(_table(spark, sf_dir, "documents"))


def op6_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.digest(docs, pii.train(docs))


def op7_line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"), F.expr("concat_ws(',', transform(links, x -> concat(x.line, ':', x.n)))").alias("line_links"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return decontaminate.find(docs, decontaminate.prepare(docs, _table(spark, sf_dir, "benchmark")))


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_language_crf": op1_language_crf,
    "op2_simhash_golay": op2_simhash_golay,
    "op3_wavelet_shards": op3_wavelet_shards,
    "op4_systematic_mix": op4_systematic_mix,
    "op5_recurring_passages": op5_recurring_passages,
    "op6_pii_bilstm_crf": op6_pii_bilstm_crf,
    "op7_line_similarity": op7_line_similarity,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity_cnn": op9_toxicity_cnn,
    "op10_bit_sliced_topk": op10_bit_sliced_topk,
}

ORACLE_SQL = {"op4_systematic_mix": OP4_SQL, "op10_bit_sliced_topk": OP10_SQL}
