"""The operators of this folder as queries over the given tables, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.llm import archives, languages, leaks, line_rules, line_windows, mixing, near_copies, negatives, preferences, ranked_search, set_join, suffix_tree, token_files
from reqsieve.llm.stored import documents
from reqsieve.session import shared_dir


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents, whose source is their host."""
    return languages.identify(documents(spark, sf_dir))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages, with markup and addresses."""
    return languages.of_pages(documents(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC files, converted to WARC and read back."""
    arc, warc = shared_dir(spark), shared_dir(spark)
    archives.write_arc(documents(spark, sf_dir, "pages"), arc)
    archives.convert(spark, arc, warc)
    return archives.page_records(spark, warc).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability by the suffix tree and by word counts."""
    return suffix_tree.score(documents(spark, sf_dir))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents, learnt from pairs of labelled ones."""
    return preferences.rank(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without passages that earlier documents have."""
    found = line_windows.drop_repeated_windows(documents(spark, sf_dir))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_removed", F.length(text).alias("n_kept_chars"), F.md5(text).alias("text_md5"))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents judged alone and by the lines they share with others of their source."""
    return line_rules.rules(documents(spark, sf_dir))


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of three-word shingles are similar to 85 percent or more."""
    return near_copies.near_copies(documents(spark, sf_dir), width=3, percent=85)


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents."""
    return leaks.find_leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources weighing 1, 2 and 3 in turn."""
    return mixing.mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token files, read back."""
    path = shared_dir(spark)
    token_files.write_tokens(documents(spark, sf_dir), path, tokenizer_path())
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector."""
    return negatives.mine(documents(spark, sf_dir, "embeddings"), label=negatives.shifted_label())


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest-scoring documents for every benchmark item."""
    return ranked_search.rank_documents(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by sets of three-word shingles that are similar to 90 percent or more."""
    return set_join.join_sets(documents(spark, sf_dir), width=3, percent=90)


QUERIES = {
    "op1_languages": op1_languages,
    "page_languages": page_languages,
    "op2_warc": op2_warc,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_preferences": op4_preferences,
    "op5_line_windows": op5_line_windows,
    "op6_line_rules": op6_line_rules,
    "op7_near_copies": op7_near_copies,
    "op8_leaks": op8_leaks,
    "op9_mixing": op9_mixing,
    "op10_tokens": op10_tokens,
    "op11_negatives": op11_negatives,
    "op12_ranked_search": op12_ranked_search,
    "op13_set_join": op13_set_join,
}

ORACLES = {
    "op2_warc": archives.ORACLE,
    "op5_line_windows": line_windows.ORACLE,
    "op6_line_rules": line_rules.ORACLE,
    "op7_near_copies": near_copies.ORACLE,
    "op11_negatives": negatives.ORACLE,
    "op12_ranked_search": ranked_search.ORACLE,
    "op13_set_join": set_join.ORACLE,
}
