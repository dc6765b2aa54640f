"""Labelled attack requests: text files of titled request blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.functions.headers import header
from reqsieve.sources.capture import record_id, with_line_order
from reqsieve.sources.messages import header_lines, headers_of, message_body, message_head, message_parts, request_line
from reqsieve.sources.requests import with_url_parts
from reqsieve.sources.uris import resolve_uri

_TITLE = "### "
_REQUEST_LINE = r"^([^ ]+) (.*) (HTTP/\d+\.\d+)$"


def scan_attack_corpus(spark: SparkSession, path: str, host: str = "localhost") -> DataFrame:
    """Requests with ``category`` (file name) and ``title``.

    A line starting with ``###`` and a title opens a block. Targets are kept as written,
    with their spaces: they are payloads, not sent requests. The title line is the record
    separator, so files of any size are split; each record ends before the next title.
    """
    records = spark.read.option("lineSep", f"\n{_TITLE}").text(resolve_uri(path))
    blocks = (
        with_line_order(
            records,
            F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("category"),
            F.regexp_replace("value", f"^{_TITLE}", "").alias("value"),
        )
        .withColumn("title", F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1)))
        .withColumn(
            "parts",
            message_parts(F.replace(
                F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"[\r\n]+\z", ""),
                F.lit("{{host}}"), F.lit(host),
            )),
        )
        .withColumn("head", message_head(F.col("parts")))
        .withColumn("line", request_line(F.col("head")))
        .where(F.col("line").rlike(_REQUEST_LINE))
        .withColumn("all_headers", headers_of(header_lines(F.col("head"))))
    )
    url = F.regexp_extract("line", _REQUEST_LINE, 2)
    columns = {
        "req_id": record_id(F.col("file"), F.col("value")),
        "req_seq": F.col("req_seq"),
        "method": F.regexp_extract("line", _REQUEST_LINE, 1),
        "url": url,
        "host": header(F.col("all_headers"), "Host"),
        "proto": F.regexp_extract("line", _REQUEST_LINE, 3),
        "headers": F.map_filter("all_headers", lambda k, v: k != "Host"),
        "body": message_body(F.col("parts")),
        "client_ip": F.lit(""),
        "ts": F.lit(""),
    }
    named = blocks.select(*[value.alias(name) for name, value in columns.items()], "category", "title")
    return with_url_parts(named)
