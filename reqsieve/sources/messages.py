"""Splitting raw HTTP messages held in a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqsieve.functions.headers import TOKEN, canonical_name, empty_headers, join_header_values
from reqsieve.functions.once import bind

_LINE = r"\r?\n"
_HEADER = rf"(?s)^{TOKEN}:.*$"


def message_parts(message: Column) -> Column:
    """Head and body of a message, parted by the first empty line.

    The body is all that follows; a declared length is not looked at.
    """
    return F.split(message, rf"{_LINE}{_LINE}", 2)


def message_head(parts: Column) -> Column:
    """Request line and headers, with folded header lines joined."""
    head = F.regexp_replace(parts[0], r"(?:\r?\n)+\z", "")
    return F.when(head.rlike(r"\n[ \t]"), F.regexp_replace(head, rf"{_LINE}[ \t]+", " ")).otherwise(head)


def message_body(parts: Column) -> Column:
    return F.coalesce(F.get(parts, 1), F.lit(""))


def request_line(head: Column) -> Column:
    return F.element_at(F.split(head, _LINE, 2), 1)


def header_lines(head: Column) -> Column:
    lines = F.split(head, _LINE)
    return F.slice(lines, F.lit(2), F.size(lines))


def headers_ok(lines: Column) -> Column:
    return F.forall(lines, lambda line: line.rlike(_HEADER))


def _entries(lines: Column) -> Column:
    return F.transform(
        F.filter(lines, lambda line: line.rlike(_HEADER)),
        lambda line: F.struct(
            F.substring_index(line, ":", 1).alias("name"),
            F.regexp_extract(line, r"(?s)^[^:]*:[ \t]*(.*?)[ \t]*$", 1).alias("value"),
        ),
    )


def headers_of(lines: Column) -> Column:
    """Header lines to a map."""
    return F.coalesce(join_header_values(_entries(lines)), empty_headers())


def header_values_of(lines: Column) -> Column:
    """Header lines to a map with every value of a repeated name by itself."""
    named = F.transform(_entries(lines), lambda e: F.struct(canonical_name(e["name"]).alias("name"), e["value"].alias("value")))

    def grouped(entries: Column) -> Column:
        names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
        return F.map_from_entries(F.transform(names, lambda n: F.struct(
            n.alias("k"), F.transform(F.filter(entries, lambda e: e["name"] == n), lambda e: e["value"]).alias("v"))))

    return bind(named, grouped)
