"""Capture files: raw requests between separator lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StructType

from reqsieve.functions.headers import header
from reqsieve.functions.once import once
from reqsieve.functions.urls import canonical_url, url_host
from reqsieve.schemas import REQUEST_COLUMNS
from reqsieve.sources.messages import (
    header_lines, header_values_of, headers_of, headers_ok, message_body, message_head, message_parts, request_line,
)
from reqsieve.sources.requests import request_problem, with_url_parts
from reqsieve.sources.uris import resolve_uri

# Fixed value: the line between two records.
SEPARATOR = "🐵🙈🙉"
# The id line of a request starts with 1 and is longer than 40 characters.
_REQUEST_RECORD = r"(?s)^1[^\n]{40,}\n."
# Fixed value: kind, id and time in nanoseconds of an id line.
_ID_LINE = r"^1 [0-9a-f]+ ([0-9]{1,18}|[0-8][0-9]{18})(?![0-9])"
_UNSEPARATED = r"\n(?=1 [0-9a-f]{24,} [0-9]+(?: [0-9]+)?\r?\n)"
_PROTOCOL = r"^HTTP/\d+\.\d+$"


def record_id(*parts: Column) -> Column:
    """An id made of a record's file and content: the same however the file is split."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def _plain_path(path: str) -> str:
    """One spelling of a path: Spark writes it with one slash or with three."""
    return re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", path)


def with_line_order(read: DataFrame, *columns: Column) -> DataFrame:
    """``file``, the columns, and ``req_seq``: the order of lines by their files' names and their places.

    A line's place is the start of its split and its number inside it. A split holds at most as many lines as bytes, so
    places rise within a file whatever the splits are, and nothing is counted beforehand: one reading, no shuffle, no
    join, and no line is lost if the splits are cut differently when the query runs. The numbers have gaps, and only
    their order is the same for all splits. The names of the files go to the tasks; files are ranked in the high bits.
    """
    ranks = {_plain_path(name): rank for rank, name in enumerate(sorted(read.inputFiles()))}
    bits = min(43, 63 - len(ranks).bit_length())  # files of up to 8 TB, less where there are more than a million
    placed = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), *columns)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0  # the split of the line before, and its lines so far
        for batch in batches:
            if not batch.num_rows:
                continue
            files, starts = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            codes, names = files.indices.to_numpy(), files.dictionary.to_pylist()
            new = np.ones(batch.num_rows, bool)
            new[1:] = (starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])
            new[0] = last != (names[codes[0]], starts[0])
            at = np.arange(batch.num_rows)
            begins = np.maximum.accumulate(np.where(new, at, -1))
            inside = np.where(begins < 0, before + at, at - begins)
            last, before = (names[codes[-1]], starts[-1]), int(inside[-1]) + 1
            base = np.array([ranks[_plain_path(n)] for n in names], np.int64) << bits
            # the first split may have a line more than bytes: the one that begins at its end
            order = base[codes] + starts + inside + (starts > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(order)], [batch.schema.names[0], *batch.schema.names[2:], "req_seq"])

    schema = StructType([f for f in placed.schema.fields if f.name != "start"]).add("req_seq", "long")
    return placed.mapInArrow(ordered, schema)


def read_capture(spark: SparkSession, path: str, stream: DataStreamReader | None = None) -> DataFrame:
    """One row per record. The separator is the line separator, so big files are split.

    Lines of the file may end in either way. A new id line starts a new record also where
    the separator is missing. ``req_seq`` is the time in the id line, 0 where there is none.
    With the reader of a stream, files are read as they arrive, each once.
    """
    text = (stream or spark.read).option("lineSep", f"\n{SEPARATOR}").text(resolve_uri(path))
    value = F.col("value")
    # Separators at the edges of a file are not between records; what is left of a line end goes.
    edged = value.rlike(rf"\A(?:\r?\n)?{SEPARATOR}|\A\r?\n")
    inner = F.when(edged, F.regexp_replace(value, rf"^(?:\r?\n)?(?:{SEPARATOR}\r?\n)*", "")).otherwise(value)
    inner = F.when(
        F.endswith(inner, F.lit("\r")) | F.endswith(inner, F.lit(SEPARATOR)), F.regexp_replace(inner, rf"(?:\r?\n{SEPARATOR})?\r?\z", "")
    ).otherwise(inner)
    pieces = F.when(F.contains(value, F.lit("\n1 ")), F.split(inner, _UNSEPARATED)).otherwise(F.array(inner))
    records = text.select(F.col("_metadata.file_path").alias("file"), F.explode(pieces).alias("value"))
    time = F.regexp_extract("value", _ID_LINE, 1).try_cast("long")
    return records.select(F.coalesce(time, F.lit(0)).alias("req_seq"), "file", "value")


def parse_capture(records: DataFrame) -> DataFrame:
    """Records to requests, with ``problem`` set on those that cannot be read.

    Records of other kinds (responses) are left out.
    """
    requests = records.where(F.col("value").rlike(_REQUEST_RECORD))
    split = once(
        requests,
        parts=message_parts(F.substr("value", F.instr("value", "\n") + 1)),
        head=message_head(F.col("parts")),
        lines=header_lines(F.col("head")),
        all_headers=headers_of(F.col("lines")),
    )
    # Three parts or none: the line is taken apart once.
    words = F.split(request_line(F.col("head")), " ")
    words = F.when((F.size(words) == 3) & F.get(words, 2).rlike(_PROTOCOL), words).otherwise(F.array(F.lit(""), F.lit(""), F.lit("")))
    lines = once(split, words=words).withColumn("target", F.get("words", 1))
    method = F.get("words", 0)
    well_formed = (F.get("words", 2) != "") & headers_ok(F.col("lines"))
    problem = (
        F.when(~well_formed, F.lit("malformed request"))
        .when(~F.col("target").rlike(r"^(/|\*$|[A-Za-z][A-Za-z0-9+.\-]*://)"), F.lit("bad target"))
        .otherwise(request_problem(method, F.col("target")))
    )
    columns = {
        "req_id": record_id(F.col("file"), F.col("value")),
        "req_seq": F.col("req_seq"),
        "method": method,
        "url": canonical_url(F.col("target")),
        "host": F.coalesce(
            F.nullif(url_host(F.col("target")), F.lit("")), header(F.col("all_headers"), "Host")
        ),
        "proto": F.get("words", 2),
        "headers": F.map_filter("all_headers", lambda k, v: k != "Host"),
        "body": message_body(F.col("parts")),
        "client_ip": F.lit(""),
        "ts": F.lit(""),
    }
    named = lines.select(
        *[value.alias(name) for name, value in columns.items()],
        F.map_filter(header_values_of(F.col("lines")), lambda k, v: k != "Host").alias("header_values"),
        problem.alias("problem"),
        F.col("value").alias("raw"),
    )
    return with_url_parts(named)


def scan_capture(spark: SparkSession, path: str, stream: DataStreamReader | None = None) -> DataFrame:
    """Requests of capture files, with ``header_values``; unreadable records are skipped."""
    parsed = parse_capture(read_capture(spark, path, stream))
    return parsed.where(F.col("problem").isNull()).select(*REQUEST_COLUMNS, "header_values")
