"""Header names, header maps and the client address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqsieve.functions.once import bind

TOKEN = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_MEMBER = rf"\s*{_STRING}\s*:\s*(?:{_STRING}|null)\s*"
# A JSON object whose values are all strings (or null).
STRING_OBJECT = rf"(?s)^\s*\{{(?:{_MEMBER}(?:,{_MEMBER})*+|\s*)\}}\s*$"

# Header names in canonical form, one per line.
_NAME = r"[A-Z0-9!#$%&'*+.^_`|~][a-z0-9!#$%&'*+.^_`|~]*+"
_CANONICAL_NAMES = rf"^(?:{_NAME}(?:-{_NAME})*+(?:\n|\z))*+\z"


def canonical_name(name: Column) -> Column:
    """``x-forwarded-for`` to ``X-Forwarded-For``; names that are no tokens stay."""
    dashed = F.replace(F.initcap(F.replace(name, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit("-"))
    return F.when(name.rlike(f"^{TOKEN}$"), dashed).otherwise(name)


def empty_headers() -> Column:
    return F.create_map().cast("map<string,string>")


def join_header_values(entries: Column) -> Column:
    """``array<struct<name,value>>`` to a map; values of a repeated name are joined with ``, ``."""

    def joined(named: Column) -> Column:
        def of(name: Column) -> Column:
            same = F.filter(named, lambda e: e["name"] == name)
            values = F.array_join(F.transform(same, lambda e: e["value"]), ", ")
            return F.struct(name.alias("k"), values.alias("v"))

        names = F.array_distinct(F.transform(named, lambda e: e["name"]))
        repeated = F.map_from_entries(F.transform(names, of))
        return F.when(F.size(names) == F.size(named), F.map_from_entries(named)).otherwise(repeated)

    named = F.transform(
        entries,
        lambda e: F.struct(canonical_name(e["name"]).alias("name"), e["value"].alias("value")),
    )
    return bind(named, joined)


def canonical_headers(headers: Column) -> Column:
    """Map with canonical names; NULL values become empty, the last of equal names wins."""

    def renamed(entries: Column) -> Column:
        names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
        last = F.transform(
            names, lambda n: F.element_at(F.filter(entries, lambda e: e["k"] == n), -1)
        )
        return F.map_from_entries(F.when(F.size(names) == F.size(entries), entries).otherwise(last))

    def entries_of(m: Column) -> Column:
        return F.transform(
            F.map_entries(m),
            lambda e: F.struct(
                canonical_name(e["key"]).alias("k"), F.coalesce(e["value"], F.lit("")).alias("v")
            ),
        )

    return bind(headers, lambda m: F.when(_is_canonical(m), m).otherwise(bind(entries_of(m), renamed)))


def _is_canonical(m: Column) -> Column:
    """Are all names canonical and different, and all values there? True for most traffic."""
    keys = F.map_keys(m)
    there = F.forall(F.map_values(m), lambda v: v.isNotNull())
    return (
        F.array_join(keys, "\n").rlike(_CANONICAL_NAMES)
        & (F.size(F.array_distinct(keys)) == F.size(keys)) & there
    )


def parse_headers(text: Column, strict: bool = True) -> Column:
    """JSON text to a header map; text that does not decode gives an empty map.

    ``strict`` refuses objects with a value that is not a string, as a decode into a
    string map does; otherwise such values are taken as text.
    """
    usable = text.isNotNull() & (text != "")
    if strict:
        usable = usable & text.rlike(STRING_OBJECT)
    parsed = F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"})
    return F.coalesce(F.when(usable, canonical_headers(parsed)), empty_headers())


def header(headers: Column, name: str) -> Column:
    """Value of a header given by its canonical name, empty when absent."""
    return F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(""))


def client_ip(headers: Column, remote_addr: Column) -> Column:
    """First part of ``X-Forwarded-For`` (as written), else the remote address."""
    forwarded = header(headers, "X-Forwarded-For")
    return F.when(forwarded != "", F.substring_index(forwarded, ",", 1)).otherwise(
        F.coalesce(remote_addr, F.lit(""))
    )
