"""Keeping runs and query results.

Everything is written below one root that all executors share:

    root/verdicts/traffic_hash=../rules_hash=../run_id=..   blocked verdicts of a run
    root/runs                                               one row per finished run
    root/keys/run_id=../buckets=../<version>                what a run's comparison needs, in buckets by request key
    root/results/<key>/<version>                            a stored query result
    root/query_results                                      one row per stored result
    root/baseline_log                                       one row per baseline change

A row in a log is appended after the data it names is complete, so a job that dies half
way leaves nothing that is ever read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reqsieve.functions.identity import DEFAULT_TTL, sql_hash
from reqsieve.operators.catalog import baseline_state, freshness, latest_run, store_stats, swapped_baseline
from reqsieve.operators.compare import diff_keyed, last_by_key
from reqsieve.operators.matching import analyze
from reqsieve.schemas import BASELINE_EVENT, KEYED, QUERY_RESULT, RUN, VERDICT
from reqsieve.session import children, create_new, exists, remove
from reqsieve.sources.rules import Rule, load_rules, rules_hash


#: Blocked requests for each bucket of a run that is stored by key.
BUCKET_KEYS = 250_000
#: How long a replaced result stays, in seconds.
GRACE = 3600


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log table, empty as long as nothing was appended."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def _append(spark: SparkSession, path: str, schema: str, row: tuple) -> None:
    """Each row is a folder of its own: writers of one folder would clear up after each other."""
    spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{path}/{uuid.uuid4().hex}")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return _read_log(spark, f"{root}/runs", RUN)


def read_verdicts(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """Stored verdicts, of all runs or of one (whose directory alone is listed and read)."""
    schema = StructType.fromDDL(VERDICT + ", traffic_hash string, rules_hash string, run_id string")
    reader = spark.read.schema(schema).option("basePath", f"{root}/verdicts")
    if run_id is None:
        return reader.parquet(f"{root}/verdicts")
    run = read_runs(spark, root).where(F.col("run_id") == run_id).first()
    if run is None:
        return spark.createDataFrame([], schema)
    return reader.parquet(_place(root, run.traffic_hash, run.rules_hash, run_id))


def _place(root: str, traffic_hash: str, rules_hash: str, run_id: str) -> str:
    return f"{root}/verdicts/traffic_hash={traffic_hash}/rules_hash={rules_hash}/run_id={run_id}"


def write_run(
    verdicts: DataFrame, traffic_hash: str, rules_hash: str, root: str,
    run_id: str | None = None,
) -> dict:
    """Store the blocked verdicts of a run and its totals, in one pass over the traffic.

    The counts are taken by the tasks that write. Spark counts the successful attempt of
    such a task only, so lost executors and speculation do not disturb the totals. Every task
    leaves a file, however few of its requests are blocked: they go to a side folder first
    and are joined into files of the size Spark advises.
    """
    spark = verdicts.sparkSession
    run_id = run_id or uuid.uuid4().hex
    seen = Observation(f"run {run_id}")
    counted = verdicts.observe(
        seen, F.count(F.lit(1)).alias("total"), F.count_if("blocked").alias("blocked")
    )
    schema = StructType.fromDDL(VERDICT)
    kept = counted.where("blocked").select(*schema.fieldNames())
    parts = f"{root}/_parts/{run_id}"
    kept.write.mode("overwrite").parquet(parts)
    stored = spark.read.schema(schema).parquet(parts).hint("rebalance")
    stored.write.mode("overwrite").parquet(_place(root, traffic_hash, rules_hash, run_id))
    remove(spark, parts)
    run = {
        "run_id": run_id, "traffic_hash": traffic_hash, "rules_hash": rules_hash, "finished_at": _now(),
        "total_requests": seen.get["total"], "blocked_requests": seen.get["blocked"],
    }
    _append(spark, f"{root}/runs", RUN, tuple(run.values()))
    return run


def _bucketed(spark: SparkSession, place: str, buckets: int) -> str:
    """The name of the table at a place. Tables are known to a session only; their files tell buckets by their names."""
    name = f"reqsieve_keys_{hashlib.sha256(place.encode()).hexdigest()[:32]}"
    spark.sql(f"create table if not exists {name} ({KEYED}) using parquet clustered by (req_key) "
              f"sorted by (req_key) into {buckets} buckets location '{place}'")
    return name


def read_keyed(spark: SparkSession, root: str, run_id: str, buckets: int) -> DataFrame:
    """The last result of every request of a stored run (``compare.last_by_key``), in buckets by request key.

    It is written when a run is first compared and only read from then on. Writers do not meet: each has a place of its
    own, and the first complete one counts.
    """
    places = f"{root}/keys/run_id={run_id}/buckets={buckets}"
    versions = sorted(children(spark, places)) if exists(spark, places) else []
    done = [v for v in versions if exists(spark, f"{places}/{v}/_SUCCESS")]
    if not done:
        done = [uuid.uuid4().hex]
        last = last_by_key(read_verdicts(spark, root, run_id)).repartition(buckets, "req_key")
        name = _bucketed(spark, f"{places}/{done[0]}", buckets)
        last.write.mode("append").format("parquet").bucketBy(buckets, "req_key").sortBy("req_key").saveAsTable(name)
    return spark.table(_bucketed(spark, f"{places}/{done[0]}", buckets))


def diff_stored(spark: SparkSession, root: str, run1: str, run2: str, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Changes between two stored runs, bucket by bucket: neither verdicts nor keys are shuffled once both are stored by key.

    The bigger run gives the number of buckets, a power of two, so a run is stored anew only when it meets a much bigger one.
    """
    sizes = read_runs(spark, root).where(F.col("run_id").isin(run1, run2)).agg(F.max("blocked_requests").alias("n")).first()
    buckets = 1 << (max(0, (sizes.n or 0) - 1) // bucket_keys).bit_length()
    return diff_keyed(*[read_keyed(spark, root, run, buckets) for run in (run1, run2)])


def export_results(verdicts: DataFrame, path: str) -> None:
    """Blocked verdicts as JSON lines, each line one result of a report."""
    verdicts.where("blocked").select(
        F.col("req_id").alias("id"),
        F.struct("method", "url", "headers", "body", "client_ip").alias("request"),
        "blocked", "rules_triggered", "interruption", "logs",
    ).write.mode("overwrite").json(path)


def export_run(spark: SparkSession, root: str, run_id: str, path: str) -> None:
    """A stored run as report lines: ``path/results`` and one line in ``path/metadata``."""
    export_results(read_verdicts(spark, root, run_id), f"{path}/results")
    run = read_runs(spark, root).where(F.col("run_id") == run_id)
    metadata = run.select(F.col("finished_at").alias("timestamp"), "total_requests", "blocked_requests",
                          "traffic_hash", "rules_hash")
    metadata.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_query_results(spark: SparkSession, root: str) -> DataFrame:
    """The newest stored result of every query."""
    log = _read_log(spark, f"{root}/query_results", QUERY_RESULT)
    newest = log.groupBy("key").agg(F.max_by(F.struct(*log.columns), "stored_at").alias("r"))
    return newest.select("r.*")


def lookup(spark: SparkSession, sql: str, root: str, ttl_seconds: int | None = None) -> str | None:
    """Where the result of a query is stored, unless it is missing, gone from its place, or too old."""
    results = read_query_results(spark, root).where(F.col("key") == sql_hash(sql))
    row = results.select("location", "stored_at", F.unix_micros(F.current_timestamp()).alias("now"),
                         F.unix_micros("stored_at").alias("at")).first()
    if row is None or (ttl_seconds and row.now - row.at > ttl_seconds * 1_000_000):
        return None
    return row.location if exists(spark, f"{row.location}/_SUCCESS") else None


def materialize(spark: SparkSession, sql: str, root: str, ttl_seconds: int = DEFAULT_TTL, grace_seconds: int = GRACE) -> DataFrame:
    """Result of a query, read from the store when it is there and fresh.

    Otherwise the query runs, its result is stored, and then read from the store; where nothing can be written to
    the store, the query itself is returned. Every result has a place of its own, and the log names it when it is complete, so
    of several writers each leaves a readable one and the newest counts. A result is removed ``grace_seconds`` after the
    next one of its query was stored: until then, what is being read stays.
    """
    stored = lookup(spark, sql, root, ttl_seconds)
    if stored is not None:
        return spark.read.parquet(stored)
    result, key = spark.sql(sql), sql_hash(sql)
    version = uuid.uuid4().hex
    location = f"{root}/results/{key}/{version}"
    try:
        create_new(spark, f"{root}/results/{key}/_writing/{version}")
    except OSError:
        return result
    result.write.parquet(location)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(location)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    _append(spark, f"{root}/query_results", QUERY_RESULT, (key, sql, location, size, _now()))
    remove(spark, f"{root}/results/{key}/_writing/{version}")
    remove_replaced(spark, root, key, grace_seconds)
    return spark.read.parquet(location)


def remove_replaced(spark: SparkSession, root: str, key: str, grace_seconds: int = GRACE) -> list[str]:
    """Remove the results of a query that were replaced longer ago than the grace time, and name them."""
    log = _read_log(spark, f"{root}/query_results", QUERY_RESULT).where(F.col("key") == key)
    places = Window.partitionBy("key").orderBy("stored_at", "location")
    replaced = log.withColumn("next", F.lead("stored_at").over(places)).where("next is not null")
    old = replaced.where(F.unix_micros(F.current_timestamp()) - F.unix_micros("next") > grace_seconds * 1_000_000)
    gone = [r.location for r in old.select("location").distinct().collect() if exists(spark, r.location)]  # one query's results
    for location in gone:
        remove(spark, location)
    return gone


def find_fresh_run(spark: SparkSession, root: str, traffic_hash: str, rules: str, ttl_seconds: int) -> str | None:
    """Id of the newest run of this traffic with these rules, if it may be reused."""
    same = read_runs(spark, root).where((F.col("traffic_hash") == traffic_hash) & (F.col("rules_hash") == rules))
    row = freshness(latest_run(same), F.current_timestamp(), ttl_seconds).where("fresh").first()
    return row.run_id if row else None


def analyze_or_reuse(
    spark: SparkSession,
    root: str,
    traffic_hash: str,
    requests: Callable[[], DataFrame],
    rules: DataFrame | Iterable[Rule],
    ttl_seconds: int = DEFAULT_TTL,
    **options,
) -> str:
    """Run id of a fresh run of this traffic with these rules and options; analyses when there is none."""
    rules = load_rules(rules)
    identity = rules_hash(rules, **options)
    found = find_fresh_run(spark, root, traffic_hash, identity, ttl_seconds)
    if found is not None:
        return found
    return write_run(analyze(requests(), rules, **options), traffic_hash, identity, root)["run_id"]


def set_baseline(spark: SparkSession, root: str, name: str | None = None, directory: str = "", traffic_hash: str | None = None) -> None:
    """Record a run as the baseline: the named one, or the newest (of a traffic source)."""
    runs = read_runs(spark, root)
    if traffic_hash is not None:
        runs = runs.where(F.col("traffic_hash") == traffic_hash)
    if name is None:
        newest = runs.orderBy(F.desc("finished_at"), F.desc("run_id")).first()
        if newest is None:
            raise ValueError("no analysis results found")
        name = newest.run_id
    elif runs.where(F.col("run_id") == name).isEmpty():
        raise ValueError(f"no run {name}")
    _append(spark, f"{root}/baseline_log", BASELINE_EVENT, (directory, name, _now()))


def read_baseline(spark: SparkSession, root: str) -> DataFrame:
    return baseline_state(_read_log(spark, f"{root}/baseline_log", BASELINE_EVENT))


def swap_baseline(spark: SparkSession, root: str, directory: str = "") -> None:
    """Exchange the current and the previous baseline."""
    set_baseline(spark, root, swapped_baseline(read_baseline(spark, root), directory), directory)


def diff_against_baseline(spark: SparkSession, root: str, traffic_hash: str, directory: str = "") -> DataFrame:
    """Changes from the baseline run to the newest run of a traffic source."""
    base = read_baseline(spark, root).where(F.col("directory") == directory).first()
    if base is None:
        raise ValueError("no baseline set")
    newest = latest_run(read_runs(spark, root).where(F.col("traffic_hash") == traffic_hash)).first()
    if newest is None:
        raise ValueError("no analysis results found")
    return diff_stored(spark, root, base.current, newest.run_id)


def status(spark: SparkSession, root: str, traffic_hash: str, directory: str = "") -> dict:
    """Newest run of a traffic source and its age, number of runs, baseline, stored results."""
    runs = read_runs(spark, root).where(F.col("traffic_hash") == traffic_hash)
    newest = freshness(latest_run(runs), F.current_timestamp(), 0).first()
    baseline = read_baseline(spark, root).where(F.col("directory") == directory).first()
    return {
        "runs": runs.count(),
        "latest": newest and newest.run_id,
        "age_seconds": newest and newest.age_seconds,
        "baseline": baseline and baseline.current,
        "previous_baseline": baseline and baseline.previous,
        **store_stats(read_query_results(spark, root)).first().asDict(),
    }
