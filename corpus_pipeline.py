"""The corpus pipeline: documents through five of the corpus operators, in order.

Language identification drops what it rejects; of each group of near-duplicates
one document stays; secrets in the texts are replaced by a mark; sources are
mixed to their target weights (a document is dropped, kept or repeated); and the
texts are encoded. Each stage reads what its predecessor wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadlens.llm import bpe, covering, langid, mixing, secrets
from threadlens.llm.common import bound_batches
from threadlens.session import scratch_path

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labels teach; the rest goes."""
    bound_batches(spark)
    return langid.identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates (4-word shingles, 4 bits)."""
    bound_batches(spark)
    return covering.keep_one(docs, shingle=4, radius=4)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets redacted."""
    bound_batches(spark)
    return secrets.redact(docs, vocabulary_path())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.remix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, lang, source, n_tokens, ids and digests."""
    bound_batches(spark)
    return bpe.encoded(docs, vocabulary_path(), keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: Fingerprints, pivotal draws and merges are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
