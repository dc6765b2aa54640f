"""Rules that change while a stream runs.

A rule table is published in versions, each a parquet table of its own below one root. Every micro-batch is matched with the
newest version that is complete when the batch first runs. Which one that was is written down before the batch is
matched, so a batch that is run again, after a failure or from a checkpoint, gets the same rules.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reqsieve.operators.matching import analyze
from reqsieve.schemas import RULE
from reqsieve.session import children, create_new, exists
from reqsieve.sources.rules import Rule, as_rule_table


def published(spark: SparkSession, root: str) -> list[int]:
    """The versions that are complete, oldest first."""
    names = children(spark, root) if exists(spark, root) else []
    found = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    return [v for v in found if exists(spark, f"{_place(root, v)}/_SUCCESS")]


def _place(root: str, version: int) -> str:
    return f"{root}/version={version}"


def publish_rules(spark: SparkSession, rules: DataFrame | Iterable[Rule], root: str) -> int:
    """Publish a rule table as the next version, and say which. Several writers get versions of their own."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([asdict(r) | {"tags": list(r.tags)} for r in rules], RULE)
    names = children(spark, f"{root}/_claims") if exists(spark, f"{root}/_claims") else []
    version = max([int(n) for n in names if n.isdigit()], default=0) + 1
    while not create_new(spark, f"{root}/_claims/{version}"):
        version += 1
    as_rule_table(rules).write.parquet(_place(root, version))
    return version


def read_rules(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(RULE).parquet(_place(root, version))


def version_of_batch(spark: SparkSession, root: str, log: str, batch_id: int) -> int:
    """The version that a micro-batch is matched with: the one written down for it, else the newest, which is then written down."""
    pinned = f"{log}/{batch_id}"
    if not exists(spark, pinned):
        versions = published(spark, root)
        if not versions:
            raise ValueError(f"no rules are published in {root}")
        create_new(spark, f"{pinned}/{versions[-1]}")
    return min(int(n) for n in children(spark, pinned) if n.isdigit())


def stream_with_rules(requests: DataFrame, root: str, out_dir: str, checkpoint: str, **options) -> StreamingQuery:
    """Blocked verdicts of a request stream in ``out_dir``, with ``rules_version``, until all is read.

    The rules are read anew for each micro-batch. Each batch is a folder of its own, which a repeated run replaces.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = version_of_batch(spark, root, f"{out_dir}/_versions", batch_id)
        verdicts = analyze(batch, read_rules(spark, root, version), **options).where("blocked")
        verdicts.withColumn("rules_version", F.lit(version)).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
