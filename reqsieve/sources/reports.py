"""Saved report documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.functions.once import once
from reqsieve.functions.text import as_text
from reqsieve.functions.headers import empty_headers
from reqsieve.functions.urls import url_host
from reqsieve.schemas import REPORT, RESULT, TRIGGERED
from reqsieve.sources.capture import with_line_order
from reqsieve.sources.requests import with_url_parts
from reqsieve.sources.uris import resolve_uri


def _verdicts(results: DataFrame) -> DataFrame:
    url = as_text(F.col("r.request.url"))
    columns = {
        "req_id": as_text(F.col("r.id")),
        "req_seq": F.col("seq").cast("long"),
        "method": as_text(F.col("r.request.method")),
        "url": url,
        "host": url_host(url),
        "proto": F.lit(""),
        "headers": F.coalesce("r.request.headers", empty_headers()),
        "body": as_text(F.col("r.request.body")),
        "client_ip": as_text(F.col("r.request.client_ip")),
        "ts": F.lit(""),
    }
    named = results.select(
        "run_id",
        *[value.alias(name) for name, value in columns.items()],
        F.coalesce("r.blocked", F.lit(False)).alias("blocked"),
        F.coalesce("r.rules_triggered", F.array().cast(f"array<{TRIGGERED}>")).alias("rules_triggered"),
        F.col("r.interruption").alias("interruption"),
        as_text(F.col("r.logs")).alias("logs"),
    )
    return with_url_parts(named)


def scan_report(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Report documents as ``(runs, verdicts)``, one run per file."""
    paths = [resolve_uri(p) for p in ([paths] if isinstance(paths, str) else paths)]
    documents = spark.read.schema(REPORT).option("multiLine", True).json(paths).withColumn(
        "run_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1)
    )
    runs = documents.select(
        "run_id",
        as_text(F.col("metadata.traffic_hash")).alias("traffic_hash"),
        as_text(F.col("metadata.rules_hash")).alias("rules_hash"),
        F.expr("try_cast(metadata.timestamp as timestamp)").alias("finished_at"),
        "metadata.total_requests",
        "metadata.blocked_requests",
    )
    results = documents.select("run_id", F.posexplode("results").alias("seq", "r"))
    return runs, _verdicts(results)


def scan_results(spark: SparkSession, path: str, run_id: str = "") -> DataFrame:
    """Verdicts from JSON lines, one result of a report per line: the scalable layout. ``req_seq`` is the order of the lines."""
    lines = with_line_order(spark.read.text(resolve_uri(path)), F.col("value")).where(F.trim("value") != "")
    parsed = once(lines, r=F.from_json("value", RESULT))
    return _verdicts(parsed.select(F.lit(run_id).alias("run_id"), F.col("req_seq").alias("seq"), "r"))
