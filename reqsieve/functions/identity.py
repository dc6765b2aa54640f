"""Identities: of a request, of a traffic source, of a rule set, of a run."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqsieve.functions.text import as_text
from reqsieve.sources.uris import resolve_uri


def request_key(method: Column, url: Column, body: Column) -> Column:
    """SHA-256 over method, URL and body. Headers and address are not part of it."""
    return F.sha2(F.concat_ws("|", as_text(method), as_text(url), as_text(body)), 256)


def short_hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 12)


def sql_hash(text: str) -> str:
    """Full SHA-256 of a SQL text: the key of its stored result."""
    return hashlib.sha256(text.encode()).hexdigest()


def traffic_hash_of_sql(text: str) -> str:
    return sql_hash(text)[:12]


#: Bits of a line's hash that enter an identity, twice; products with line numbers stay below 38 digits.
_LINE_BITS = 40


def _line_hash(start: int) -> Column:
    digits = _LINE_BITS // 4
    return F.conv(F.substring(F.md5("value"), start, digits), 16, 10).cast("decimal(38,0)")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, lines, digest``: the content of every file, in which the order of lines counts.

    The same at any size and however files are split: lines are hashed where they are read and
    enter with their numbers, as sums that are put together per split, split by split and file
    by file. No task holds a file.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(resolve_uri(path))
    hashes = {"a": _line_hash(1), "b": _line_hash(1 + _LINE_BITS // 4)}
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"),
        *[h.alias(n) for n, h in hashes.items()],
    )
    at = F.col("at").cast("decimal(38,0)") % F.lit(1 << 33)
    splits = lines.groupBy("file", "bytes", "start").agg(
        F.count(F.lit(1)).alias("lines"), F.min(at).alias("first"),
        *[F.sum(n).alias(n) for n in hashes], *[F.sum(F.col(n) * at).alias(f"{n}_at") for n in hashes],
    )
    before = F.coalesce(
        F.sum("lines").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = splits.withColumn("shift", (before - F.col("first")).cast("decimal(38,0)"))
    placed = [F.sum(F.col(f"{n}_at") + F.col(n) * F.col("shift")) for n in hashes]
    files = shifted.groupBy("file", "bytes").agg(
        F.sum("lines").alias("lines"), F.concat_ws(":", *[F.sum(n) for n in hashes], *placed).alias("sums"))
    return files.select(
        "file", "bytes", "lines", F.sha2(F.concat_ws(":", F.col("bytes"), F.col("lines"), F.col("sums")), 256).alias("digest"))


def files_hash(spark: SparkSession, path: str) -> str:
    """12-character identity of the content of a file, or of all files below a path.

    Names and places of the files are not part of it, their number and borders are.
    """
    part = F.conv(F.substring("digest", 1, 14), 16, 10).cast("decimal(38,0)")
    total = file_digests(spark, path).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum(part).alias("sum"), F.max("digest").alias("most")).first()
    if not total.n:
        raise FileNotFoundError(path)
    return sql_hash(f"{total.n}:{total.bytes}:{total.sum}:{total.most}")[:12]


def run_name(traffic: Column, rules: Column) -> Column:
    return F.concat(traffic, F.lit("-"), rules)


def parse_run_name(name: Column) -> Column:
    """``<12>-<12>`` with or without ``.json`` as a struct of both hashes, else NULL."""
    stem = F.regexp_replace(name, r"\.json\z", "")
    ok = stem.rlike(r"(?s)\A[^-]{12}-.{12}\z")
    return F.when(
        ok,
        F.struct(
            F.substring(stem, 1, 12).alias("traffic_hash"),
            F.substring(stem, 14, 12).alias("rules_hash"),
        ),
    )


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}
DEFAULT_TTL = 24 * 3600


def duration_seconds(text: str | None) -> int:
    """``"24h"``, ``"1h30m"`` or ``"0"`` in seconds; unreadable text means 24 hours."""
    if text == "0":
        return 0
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", text or "")
    if not parts or "".join(n + u for n, u in parts) != text:
        return DEFAULT_TTL
    return int(sum(float(n) * _UNITS[u] for n, u in parts))
