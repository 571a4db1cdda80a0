"""A corpus pipeline over the text operators: from documents to token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. It works on
all rows that its predecessor kept. Labels, benchmark and training rows come from the tables in sf_dir.

In every stage: texts are read whole, however long; nulls in other columns and columns beyond those of documents are carried along;
an empty table gives no rows; executors give memory back before it begins. What a stage does with null and empty texts, null or repeated ids and ties is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontaminate, mixing, near, toxicity, wavelet
from lattica.llm.common import shrink, stage
from lattica.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go. Null and empty texts are scored as one without words; rows that repeat
    are scored alike. Without labelled rows of both classes nothing goes."""
    shrink(spark)
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.keep_clean(docs, toxicity.train(documents, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard 0.8 of five-word shingles), the document of the smallest doc_id stays.

    Null, empty and wordless texts are one group. Rows of one doc_id stay or go together; a null doc_id stays if its group has no
    other row."""
    shrink(spark)
    return near.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go. Null and empty texts stay; rows that repeat are searched alike."""
    shrink(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.keep_clean(docs, decontaminate.prepare(docs, benchmark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to two times. Null texts count no words and null sources are a source; ties in
    size go by doc_id; rows that repeat are documents of their own."""
    shrink(spark)
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in token shards; one row for each document in them, read back from the files. Null and empty texts are documents of
    the end id alone; null ids come first; the copies that the mix made stand next to each other."""
    shrink(spark)
    return wavelet.encode_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Trained and iterative stages can't be written in SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
