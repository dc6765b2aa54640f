"""JSON lines: one object per request with method, url, headers and body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.functions.headers import canonical_headers, empty_headers
from reqsieve.functions.once import once
from reqsieve.functions.text import as_text
from reqsieve.functions.urls import canonical_url, url_host
from reqsieve.schemas import REQUEST_COLUMNS
from reqsieve.sources.capture import record_id, with_line_order
from reqsieve.sources.requests import request_problem, with_url_parts
from reqsieve.sources.uris import resolve_uri

_LOOSE = "method string, url string, headers map<string,string>, body string, broken string"
_TYPED = "method variant, url variant, headers map<string,variant>, body variant, broken string"
_OPTIONS = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "broken"}
# A value may not be followed by anything else on its line.
_OBJECT = r"(?s)^\s*\{.*\}\s*$"


_NAMES = ("method", "url", "headers", "body")
_OTHER_CASE = rf'(?<!\\)"(?!(?:{"|".join(_NAMES)})")(?i:{"|".join(_NAMES)})"\s*:'


def _plain_names(line: Column) -> Column:
    """Field names count in any case. Header names do anyway, so it does not matter where the name stands."""
    plain = line
    for name in _NAMES:
        plain = F.regexp_replace(plain, rf'(?<!\\)"(?i:{name})"(?=\s*:)', f'"{name}"')
    return F.when(line.rlike(_OTHER_CASE), plain).otherwise(line)


def _is_text(value: Column) -> Column:
    return value.isNull() | F.schema_of_variant(value).isin("STRING", "VOID")


def _decode(strict: bool) -> tuple[Column, dict[str, Column]]:
    """``(is broken, fields)`` of the parsed column ``j``."""
    fields = {name: F.col(f"j.{name}") for name in ("method", "url", "headers", "body")}
    broken = F.col("j").isNull() | F.col("j.broken").isNotNull()
    if not strict:
        return broken, fields
    header_values = F.coalesce(F.map_values("j.headers"), F.array().cast("array<variant>"))
    typed = F.forall(header_values, _is_text)
    for name in ("method", "url", "body"):
        typed = typed & _is_text(fields[name])
        fields[name] = fields[name].cast("string")
    fields["headers"] = F.transform_values("j.headers", lambda k, v: v.cast("string"))
    return broken | ~typed, fields


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line; ``req_seq`` follows the names of the files and the order of their lines."""
    return with_line_order(spark.read.text(resolve_uri(path)), F.col("value"))


def parse_ndjson(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Lines to requests, with ``problem`` set on those that cannot be read.

    ``strict`` also refuses lines in which a field has another type than text.
    """
    parsed = F.from_json(_plain_names(F.col("value")), _TYPED if strict else _LOOSE, _OPTIONS)
    decoded = once(lines, j=F.when(F.col("value").rlike(_OBJECT), parsed))
    broken, fields = _decode(strict)
    method = F.coalesce(F.nullif(fields["method"], F.lit("")), F.lit("GET"))
    target = as_text(fields["url"])
    columns = {
        "req_id": record_id(F.col("file"), F.col("value")),
        "req_seq": F.col("req_seq"),
        "method": method,
        "url": canonical_url(target),
        "host": url_host(target, authority=True),
        "proto": F.lit("HTTP/1.1"),
        "headers": F.coalesce(canonical_headers(fields["headers"]), empty_headers()),
        "body": as_text(fields["body"]),
        "client_ip": F.lit(""),
        "ts": F.lit(""),
    }
    problem = F.when(broken, F.lit("malformed json")).otherwise(request_problem(method, target))
    named = decoded.select(
        *[value.alias(name) for name, value in columns.items()],
        problem.alias("problem"),
        F.col("value").alias("raw"),
    )
    return with_url_parts(named, authority=True)


def scan_ndjson(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Requests of JSON-lines files; unreadable lines are skipped."""
    parsed = parse_ndjson(read_lines(spark, path), strict)
    return parsed.where(F.col("problem").isNull()).select(*REQUEST_COLUMNS)
