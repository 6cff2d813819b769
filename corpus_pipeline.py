"""A corpus pipeline: each stage reads what the one before kept, and its decisions take effect.

Stages are written as Parquet in the shared folder and read again, so a lost executor repeats
tasks of one stage at most; a stage's goes when the next one's is written. Five of the ten operators are stages; the others are no filters of whole documents, or judge other tables.

Every stage but the last returns the columns of documents, extra ones with them, whatever their names, and works on whole
texts. An empty table gives an empty result in each. Null or blank texts fail the quality rules, so the pipeline drops them there;
the later stages, called by themselves, keep them, but for mixing, which takes no document without words, and the token store,
which has only the end id for them. A null language is a language and a null source a source. Rows are judged one by one: repeated rows and
equal doc_ids are kept or dropped each by its text, but for near-dedup, which leaves one of equal texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, near_dup, quality, token_store
from tessera.llm.common import Scratch

#: Words that a worker of the token store remembers: about 70 MB, as executors hold memory of earlier stages.
WORDS = 300_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's fertility bands go. Null and blank texts fail; ties at a band's edge stay."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by op6's rule or by 5-word shingles at 80 per cent, the document with the smallest doc_id stays.

    A null doc_id counts as the largest; of rows with one doc_id and equal texts one stays; null and blank texts stay."""
    return near_dup.drop_near_duplicates(docs, near_dup.STAGE)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go. Null and blank texts, and all where the benchmark is empty, stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per use of a document in the mix, whole. Documents without words are not taken; rows with one doc_id are ordered by size and text."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from the token store's files. A null text has the end id alone, a null doc_id comes first."""
    return token_store.token_ids(docs, words=WORDS)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_output),
]

#: Tokenisation and the bands of measured fertility are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch()
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
