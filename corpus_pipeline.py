"""Documents to training files: operators of ``reqsieve.llm`` in a row.

Each stage gets the documents its predecessor kept and returns documents; the last one writes token
files and returns a row per document of them. Every stage's documents are written before the next
one reads them, so what is lost with an executor is made again from the last written table.

The language stage rejects documents without letters and those whose language is unclear; of every
group of near-copies one document goes on; documents that hold a benchmark item go; the mix takes
documents as often as it draws them, so from there on a document can occur up to three times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reqsieve.llm import languages, leaks, mixing, near_copies, token_files
from reqsieve.llm.queries import tokenizer_path
from reqsieve.llm.stored import documents, settle
from reqsieve.session import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    return languages.drop_unidentified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five-word shingles, similarity 0.8)."""
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return leaks.without_leaks(docs, documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources draws them, in the order of its shards."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    path = shared_dir(spark)
    token_files.write_tokens(docs, path, tokenizer_path())
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language id", language_id),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token files", tokens),
]

#: Near-copies, edit distances and tokenizers have no SQL; tests/llm holds the stages against plain loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        docs = made if name == STAGES[-1][0] else settle(made)
    return docs
