"""Traffic from parquet files and from any SELECT."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.sources.requests import check_mapping, map_columns, usable_rows
from reqsieve.sources.uris import resolve_uri


def read_parquet(
    spark: SparkSession, path: str | list[str], base_path: str | None = None, where: str | Column | None = None
) -> DataFrame:
    """Parquet files, with partition directories below ``base_path`` as columns.

    ``where`` may use partition columns, which prunes directories, and file columns,
    which Spark pushes into the scan.
    """
    paths = [resolve_uri(p) for p in ([path] if isinstance(path, str) else path)]
    reader = spark.read
    if base_path is not None:
        reader = reader.option("basePath", resolve_uri(base_path))
    df = reader.parquet(*paths)
    return df if where is None else df.where(where)


def scan_parquet(
    spark: SparkSession,
    path: str | list[str],
    columns: Mapping[str, str],
    base_path: str | None = None,
    where: str | Column | None = None,
) -> DataFrame:
    """Requests of parquet files, by column mapping.

    Without an ``id`` mapping the id is made of file and row position, which are the
    same on every read.
    """
    check_mapping(columns)
    df, mapping = read_parquet(spark, path, base_path, where), dict(columns)
    if "id" not in mapping:
        place = F.concat_ws("-", F.substring(F.sha2(F.col("_metadata.file_path"), 256), 1, 12),
                            F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"))
        df = df.withColumns({"__place": place, "__row": F.col("_metadata.row_index")})
        mapping = {"seq": "__row", **mapping, "id": "__place"}
    return map_columns(usable_rows(df, mapping), mapping)


def scan_sql(spark: SparkSession, select_text: str, columns: Mapping[str, str]) -> DataFrame:
    """Requests made of the rows of any SELECT."""
    if not select_text.strip():
        raise ValueError("query is required")
    return map_columns(usable_rows(spark.sql(select_text), columns), columns)
