"""How well a rule set tells attacks from legitimate requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per category: requests, blocked, and the share that went as expected.

    ``labels`` has ``req_id, category, attack``: attacks should be blocked, others
    should pass. Only ids and one flag of the verdicts take part in the join.
    """
    seen = labels.join(verdicts.select("req_id", "blocked"), "req_id")
    expected = F.col("blocked") == F.col("attack")
    return seen.groupBy("category", "attack").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("blocked").alias("blocked"),
        F.avg(F.col("blocked").cast("int")).alias("blocked_rate"),
        F.avg(expected.cast("int")).alias("expected_rate"),
    )


def false_positive_rate(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Share of legitimate requests that were blocked, and of attacks that passed."""
    seen = labels.join(verdicts.select("req_id", "blocked"), "req_id")
    return seen.agg(
        F.avg(F.when(~F.col("attack"), F.col("blocked").cast("int"))).alias("false_positive_rate"),
        F.avg(F.when(F.col("attack"), (~F.col("blocked")).cast("int"))).alias("miss_rate"),
    )
