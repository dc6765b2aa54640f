"""Evaluating an expensive expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it.

    Expressions below higher-order functions are not shared by the optimizer: without
    this, a parsed document would be parsed again wherever it is looked at.
    """
    return F.transform(F.array(value), use)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A filter on something made of a column is pushed below the projection that makes the
    column, along with a copy of all its work for every mention. A generator of one row
    is a place it cannot pass.
    """
    for name, value in columns.items():
        df = df.select("*", F.stack(F.lit(1), value).alias(name))
    return df
