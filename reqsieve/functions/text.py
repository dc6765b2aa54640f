"""Small text helpers shared by listings and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names by code 0..7.
SEVERITY_NAMES = ["EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG"]


def as_text(value: Column) -> Column:
    """Any column as text, NULL as empty."""
    return F.coalesce(value.cast("string"), F.lit(""))


body_text = as_text


def body_size(body: Column) -> Column:
    """Size of a body in bytes."""
    return F.octet_length(F.coalesce(body, F.lit(""))).cast("long")


def placeholder(value: Column, text: str) -> Column:
    """``text`` where the value is empty or NULL."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(text))


def ellipsize(value: Column, limit: int, style: str = "list") -> Column:
    """Shorten text longer than ``limit`` characters.

    ``list`` keeps ``limit - 1`` characters and adds one ellipsis sign, ``detail`` keeps
    ``limit`` characters and adds three dots.
    """
    if style == "list":
        short = F.concat(F.substring(value, 1, limit - 1), F.lit("…"))
    elif style == "detail":
        short = F.concat(F.substring(value, 1, limit), F.lit("..."))
    else:
        raise ValueError(f"unknown style {style!r}")
    return F.when(F.length(value) > limit, short).otherwise(value)


def severity_name(code: Column) -> Column:
    """Name of a severity code, ``UNKNOWN`` outside 0..7."""
    names = F.array(*[F.lit(n) for n in SEVERITY_NAMES])
    known = code.between(0, len(SEVERITY_NAMES) - 1)
    return F.when(known, F.try_element_at(names, code.cast("int") + 1)).otherwise(F.lit("UNKNOWN"))
