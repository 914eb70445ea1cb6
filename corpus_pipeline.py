"""The corpus pipeline: languages, near duplicates, personal data, source mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.langid import keep_languages
from tessella.llm.mixing import mix
from tessella.llm.near_dedup import near_dedup
from tessella.llm.packing import pack
from tessella.llm.pii import redact
from tessella.llm.shared import scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: null texts, texts without a letter, and those far from every language learned. Each row is
    judged by its own text, whatever its doc_id; repeated rows alike. Where no row has a lang, nothing is known and all stay. An empty
    table stays empty; all columns pass through."""
    return keep_languages(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id; repeated rows are near each other. Texts without words
    are near nothing: of each doc_id one stays, of null ones all. An empty table stays empty; all columns pass through."""
    return near_dedup(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind, and n_chars is the new length. No row goes; null texts stay null. An empty table
    stays empty; other columns pass through."""
    return redact(docs)


def pareto_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, whole copies side by side; documents without words are not taken, a null source is
    a source. Repeated rows are drawn each for itself. An empty table stays empty; all columns pass through."""
    return mix(docs)


def vector_best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixture and their places in the training sequences: every copy is packed, null and empty texts as their end mark,
    long ones in several pieces. An empty table gives no pieces."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("pii", pii),
    ("pareto_mixture", pareto_mixture),
    ("vector_best_fit", vector_best_fit),
]

#: Language models, MinHash signatures and tokens have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
