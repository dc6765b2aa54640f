"""Questions about the table of runs, the baseline log and the stored results.

All of them are aggregations that keep one or two rows per group on the map side, so a
traffic source with most of the runs is no special case, and no run meets another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _newest(row: Column, *order: str) -> Column:
    return F.max_by(row, F.struct(*order))


def latest_run(runs: DataFrame, *order: str) -> DataFrame:
    """The newest run of every traffic source."""
    order = order or ("finished_at", "run_id")
    newest = runs.groupBy("traffic_hash").agg(_newest(F.struct(*runs.columns), *order).alias("r"))
    return newest.select("r.*")


def two_latest(df: DataFrame, group: str, value: str, row: list[str], *order: str) -> DataFrame:
    """Per group, the rows of the two ``value``s that were used last: ``first``, ``second``.

    Each value is reduced to its newest row; ranking those sends two rows per group and
    task, since Spark applies a rank limit before the shuffle too.
    """
    keep = F.struct(*dict.fromkeys([*row, value]))
    by_value = df.groupBy(group, value).agg(
        F.max(F.struct(F.struct(*order).alias("o"), keep.alias("r"))).alias("m")
    )
    by_age = Window.partitionBy(group).orderBy(F.desc("m"))
    top = by_value.withColumn("rank", F.row_number().over(by_age)).where(F.col("rank") <= 2)
    return top.groupBy(group).agg(*[
        F.max(F.when(F.col("rank") == k, F.col("m"))).getField("r").alias(name)
        for k, name in ((1, "first"), (2, "second"))
    ])


def previous_run_other_rules(runs: DataFrame, *order: str) -> DataFrame:
    """For every run, the newest run of the same traffic with another rule set.

    That is the newest run of the traffic, or the newest with other rules than that one.
    """
    order = order or ("finished_at", "run_id")
    best = two_latest(runs, "traffic_hash", "rules_hash", ["run_id"], *order)
    same = F.col("rules_hash") == F.col("first.rules_hash")
    previous = F.when(same, F.col("second.run_id")).otherwise(F.col("first.run_id"))
    return runs.join(best, "traffic_hash").select(
        "run_id", "traffic_hash", "rules_hash", previous.alias("previous_run_id")
    )


def runs_per_traffic(runs: DataFrame) -> DataFrame:
    return runs.groupBy("traffic_hash").agg(F.count(F.lit(1)).alias("runs"))


def baseline_state(log: DataFrame, *order: str) -> DataFrame:
    """Current and previous baseline per directory.

    Setting a name again changes nothing, so the two are the names that were set last.
    Swapping is setting the previous name.
    """
    pair = two_latest(log, "directory", "name", ["name"], *(order or ("at",)))
    return pair.select("directory", F.col("first.name").alias("current"), F.col("second.name").alias("previous"))


def swapped_baseline(state: DataFrame, directory: str) -> str:
    """The name to set when swapping; an error when there is no previous one."""
    row = state.where(F.col("directory") == directory).select("previous").first()
    if row is None or row.previous is None:
        raise ValueError("no previous baseline to swap to")
    return row.previous


def freshness(runs: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Age of every run in whole seconds, and whether it may be reused (TTL 0: always)."""
    finished = F.col("finished_at").cast("timestamp")
    micros = F.unix_micros(now) - F.unix_micros(finished)
    age = F.floor(micros / 1_000_000).cast("long")
    fresh = F.lit(True) if ttl_seconds == 0 else micros <= ttl_seconds * 1_000_000
    return runs.withColumns({"age_seconds": age, "fresh": fresh})


def store_stats(results: DataFrame) -> DataFrame:
    """Number of stored query results and their size in MB."""
    return results.agg(
        F.count(F.lit(1)).alias("entries"),
        (F.coalesce(F.sum("size"), F.lit(0)) / F.lit(1048576.0)).alias("total_mb"),
    )


def store_list(results: DataFrame) -> DataFrame:
    """Stored query results with their short key, size in MB and query."""
    return results.select(
        F.substring("key", 1, 12).alias("key"), (F.col("size") / F.lit(1048576.0)).alias("mb"), "query"
    )
