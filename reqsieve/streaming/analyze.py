"""The analysis as a stream: new traffic files are analysed as they arrive."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reqsieve.operators.matching import analyze
from reqsieve.operators.reports import totals
from reqsieve.schemas import REQUEST_COLUMNS
from reqsieve.session import folders
from reqsieve.sources.capture import scan_capture
from reqsieve.sources.ndjson import parse_ndjson
from reqsieve.sources.requests import map_columns, usable_rows
from reqsieve.sources.rules import Rule, load_rules
from reqsieve.sources.uris import resolve_uri


def stream_ndjson(spark: SparkSession, in_dir: str, files_per_trigger: int = 1000, strict: bool = True) -> DataFrame:
    """Requests of JSON-lines files as a stream.

    A position in a file is not known to a stream, so the id comes from file and line
    text, and there is no sequence number.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(resolve_uri(in_dir)).select(
        F.lit(0).cast("long").alias("req_seq"), F.col("_metadata.file_path").alias("file"), "value"
    )
    return parse_ndjson(lines, strict).where(F.col("problem").isNull()).select(*REQUEST_COLUMNS)


def stream_capture(spark: SparkSession, in_dir: str, files_per_trigger: int = 1000) -> DataFrame:
    """Requests of capture files as a stream: the rows of ``scan_capture``, with the same ids and numbers.

    The stream remembers files, so a capture must be complete when it appears in the folder. A big one is split.
    """
    return scan_capture(spark, in_dir, spark.readStream.option("maxFilesPerTrigger", files_per_trigger))


def stream_parquet(
    spark: SparkSession, in_dir: str, columns: Mapping[str, str], files: str = "*.parquet", files_per_trigger: int = 1000
) -> DataFrame:
    """Requests of parquet files as a stream, by column mapping. The layout is that of the files there now.

    ``files`` may also name tables that are folders of files.
    """
    in_dir, chosen = resolve_uri(in_dir), {"pathGlobFilter": files}
    if folders(spark, f"{in_dir}/{files}"):
        in_dir, chosen = f"{in_dir.rstrip('/')}/{files}", {}
    schema = spark.read.options(**chosen).parquet(in_dir).schema
    rows = spark.readStream.schema(schema).options(**chosen, maxFilesPerTrigger=files_per_trigger).parquet(in_dir)
    return map_columns(usable_rows(rows, columns), columns)


def stream_analyze(
    requests: DataFrame, rules: DataFrame | Iterable[Rule], out_dir: str, checkpoint: str, **options
) -> StreamingQuery:
    """Append the blocked verdicts of a request stream to ``out_dir``, then stop when all is read.

    Matching is a narrow projection, so there is no state and no shuffle. Call it again to
    continue with the files that arrived since.
    """
    verdicts = analyze(requests, rules, **options).where("blocked")
    return (
        verdicts.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def stream_totals(
    requests: DataFrame, rules: DataFrame | Iterable[Rule], out_dir: str, checkpoint: str, **options
) -> StreamingQuery:
    """Keep running totals of a request stream in ``out_dir``: one row per micro-batch.

    The state is two counters; tasks add up their rows before they meet.
    """
    running = totals(analyze(requests, rules, **options))

    def write(batch: DataFrame, batch_id: int) -> None:
        row = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        row.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return (
        running.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )


def read_stream_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """The totals after the last micro-batch."""
    history = spark.read.parquet(out_dir)
    return history.agg(F.max_by(F.struct("total_requests", "blocked_requests"), "batch_id").alias("t")).select("t.*")


def stream_observed_totals(
    requests: DataFrame, rules: DataFrame | Iterable[Rule], out_dir: str, checkpoint: str, **options
) -> StreamingQuery:
    """Blocked verdicts of a request stream in ``out_dir/verdicts``, and what each micro-batch counted in ``out_dir/totals``.

    The tasks that write the verdicts count them, so there is no state, no shuffle and no second pass. Both are written under
    the number of the batch before it is committed: a batch that is run again after a failure replaces what it left.
    """
    rules = load_rules(rules)

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"batch {batch_id}")
        counted = analyze(batch, rules, **options).observe(
            seen, F.count(F.lit(1)).alias("total_requests"), F.count_if("blocked").alias("blocked_requests"))
        counted.where("blocked").write.mode("overwrite").parquet(f"{out_dir}/verdicts/batch={batch_id}")
        row = (batch_id, seen.get["total_requests"], seen.get["blocked_requests"])
        made = batch.sparkSession.createDataFrame([row], "batch_id long, total_requests long, blocked_requests long")
        made.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/totals/batch={batch_id}")

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def read_observed_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """The running totals: what all micro-batches counted together."""
    batches = spark.read.parquet(f"{out_dir}/totals")
    return batches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_requests", "blocked_requests")])
