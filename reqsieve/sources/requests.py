"""Bringing any table into the request layout."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from reqsieve.functions.headers import TOKEN, canonical_headers, empty_headers, parse_headers
from reqsieve.functions.text import as_text
from reqsieve.functions.urls import canonical_url, url_host, url_path, url_problem, url_query
from reqsieve.schemas import REQUEST_COLUMNS

LOGICAL_FIELDS = ["method", "path", "host", "proto", "headers", "body", "client_ip", "timestamp"]


def check_mapping(mapping: Mapping[str, str]) -> None:
    unknown = set(mapping) - set(LOGICAL_FIELDS) - {"id", "seq"}
    if unknown:
        raise ValueError(f"unknown logical fields: {sorted(unknown)}")
    if not mapping.get("method") or not mapping.get("path"):
        raise ValueError("column mapping for method and path is required")


def _text(df: DataFrame, mapping: Mapping[str, str], field: str) -> Column:
    name = mapping.get(field)
    return as_text(F.col(f"`{name}`")) if name in df.columns else F.lit("")


def usable_rows(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rows that will make a request: with a method and a path that are well formed.

    Looks at the physical columns, so the filter runs before any mapping.
    """
    check_mapping(mapping)
    method, path = _text(df, mapping, "method"), _text(df, mapping, "path")
    return df.where((path != "") & request_problem(method, path).isNull())


def map_columns(df: DataFrame, mapping: Mapping[str, str], strict_headers: bool = True) -> DataFrame:
    """Select the request columns from a table, by column name.

    ``mapping`` goes from logical field to physical column. A field that is not mapped
    or whose column is missing reads as empty, and so does NULL; only, without a mapping
    the host is the one in the URL and the protocol is HTTP/1.1. Two more keys name the
    columns to take ``req_id`` (else a hash of the content) and ``req_seq`` from (else, and
    where a value is no number, 0).
    """
    check_mapping(mapping)
    host = _text(df, mapping, "host") if mapping.get("host") else url_host(_text(df, mapping, "path"), authority=True)
    proto = _text(df, mapping, "proto") if mapping.get("proto") else F.lit("HTTP/1.1")

    def text(field: str) -> Column:
        return _text(df, mapping, field)

    header_name = mapping.get("headers")
    if header_name not in df.columns:
        headers = empty_headers()
    elif isinstance(df.schema[header_name].dataType, MapType):
        named = F.col(f"`{header_name}`").cast("map<string,string>")
        headers = F.coalesce(canonical_headers(named), empty_headers())
    else:
        headers = parse_headers(text("headers"), strict=strict_headers)

    if mapping.get("id") in df.columns:
        req_id = text("id")
    else:
        req_id = F.sha2(F.concat_ws("\x1f", *[text(f) for f in LOGICAL_FIELDS]), 256)
    seq = F.col(f"`{mapping['seq']}`") if mapping.get("seq") in df.columns else F.lit(0)
    named = df.select(
        req_id.alias("req_id"),
        F.coalesce(seq.try_cast("long"), F.lit(0)).alias("req_seq"),
        text("method").alias("method"),
        canonical_url(text("path")).alias("url"),
        host.alias("host"),
        proto.alias("proto"),
        headers.alias("headers"),
        text("body").alias("body"),
        text("client_ip").alias("client_ip"),
        text("timestamp").alias("ts"),
    )
    return with_url_parts(named, authority=True)


def with_url_parts(df: DataFrame, authority: bool = False) -> DataFrame:
    """Add path and query, and put the request columns first."""
    parts = df.withColumns({"path": url_path(F.col("url"), authority), "query": url_query(F.col("url"))})
    return parts.select(*REQUEST_COLUMNS, *[c for c in df.columns if c not in REQUEST_COLUMNS])


def spread(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread rows over all cores when they come in fewer partitions.

    Parsing and matching are bound by CPU, so a few big files or row groups would leave
    most cores idle. Best applied to the rows as read: a table that is shuffled anyway has
    as many tasks as its shuffle, and so is left alone, as is one with a task for every core.
    """
    if rows.isStreaming:
        return rows
    plan = rows._jdf.queryExecution().executedPlan()
    if partitions is None and plan.nodeName().startswith("AdaptiveSparkPlan"):
        return rows
    wanted = partitions or rows.sparkSession.sparkContext.defaultParallelism
    return rows if partitions is None and _scanned_in(rows) >= wanted else rows.repartition(wanted)


def _scanned_in(rows: DataFrame) -> int:
    """The number of tasks of a table that needs no shuffle; nothing runs to find it."""
    return rows._jdf.queryExecution().toRdd().getNumPartitions()


def with_req_id(requests: DataFrame, random: bool = False) -> DataFrame:
    """Give requests new ids: a hash of position and content, the same on every run, or
    a random one."""
    parts = ["req_seq", "method", "url", "host", "body", "client_ip", "ts"]
    fixed = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return requests.withColumn("req_id", F.uuid() if random else fixed)


def with_timestamp(requests: DataFrame) -> DataFrame:
    """Add the capture time as a timestamp, NULL where the text is none."""
    return requests.withColumn("ts_at", F.try_to_timestamp("ts"))


def require_fields(df: DataFrame) -> DataFrame:
    """Keep requests that have a method and a URL."""
    return df.where((F.col("method") != "") & (F.col("url") != ""))


def request_problem(method: Column, url: Column) -> Column:
    """Why a request line is unusable, or NULL."""
    return (
        F.when(F.coalesce(method, F.lit("")) == "", F.lit("no method"))
        .when(~method.rlike(f"^{TOKEN}$"), F.lit("bad method"))
        .otherwise(url_problem(url))
    )


def split_malformed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of a source split into requests and rejected ones (with ``problem``)."""
    good = parsed.where(F.col("problem").isNull()).select(*REQUEST_COLUMNS)
    return good, parsed.where(F.col("problem").isNotNull())


def observe_rejected(parsed: DataFrame, seen: Observation) -> DataFrame:
    """Requests of parsed records, counting ``records`` and ``rejected`` ones as they pass by."""
    counted = parsed.observe(
        seen, F.count(F.lit(1)).alias("records"), F.count_if(F.col("problem").isNotNull()).alias("rejected")
    )
    return split_malformed(counted)[0]


def union_sources(*sources: DataFrame) -> DataFrame:
    """Several request tables analysed as one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
