"""Intermediate tables and sizes, as all operators of this folder use them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.session import shared_dir


def settle(df: DataFrame, options: dict[str, str] = {}) -> DataFrame:
    """Write a table to the shared folder, with these options of the writer, and read it back.

    It cuts the lineage, and executors that are lost later take nothing with them.
    """
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session, for what runs meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: Column | str) -> DataFrame:
    """A table of just these columns, whatever else it holds."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def parts_for(df: DataFrame, size: Column, each: int) -> int:
    """How many parts of about ``each`` bytes a table makes."""
    total = df.select(F.sum(size.cast("long"))).first()[0] or 0
    return max(1, -(-total // each))
