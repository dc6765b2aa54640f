"""Comparing two runs over the same traffic.

Both runs go through one aggregation by request key: one shuffle, with the last result
per key and side picked on the map side already, so a key that makes up a third of the
traffic arrives as one row per task. Only ids and rules take part; whole results are
fetched afterwards, for the changed requests alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.functions.identity import request_key
from reqsieve.functions.text import placeholder
from reqsieve.session import written

# The mark, list entry and group name of each kind of change.
MARKS = {"added": "[+]", "removed": "[-]", "modified": "[~]"}
MEANINGS = {"added": "New blocked request", "removed": "No longer blocked", "modified": "Rules changed"}
GROUPS = {"added": "Added", "removed": "Removed", "modified": "Modified"}


def _choose(diff_type: Column, names: dict[str, str]) -> Column:
    chosen = F.lit(None).cast("string")
    for kind, name in names.items():
        chosen = F.when(diff_type == kind, F.lit(name)).otherwise(chosen)
    return chosen


def with_key(verdicts: DataFrame) -> DataFrame:
    return verdicts.withColumn("req_key", request_key(F.col("method"), F.col("url"), F.col("body")))


def _order() -> Column:
    """Capture order; a result without a number comes before all others."""
    return F.struct(F.coalesce("req_seq", F.lit(-(1 << 63))).alias("req_seq"), F.col("req_id"))


def _last(verdicts: DataFrame) -> DataFrame:
    """``req_key, o``: where the last result of every request stands."""
    return with_key(verdicts).select("req_key", _order().alias("o")).groupBy("req_key").agg(F.max("o").alias("o"))


def _whole(verdicts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The results at the wanted places. Only here do whole rows take part."""
    rows = with_key(verdicts).select("req_key", _order().alias("o"), *[F.col(c) for c in verdicts.columns])
    keys = ["req_key", "o"]
    return rows.join(wanted, keys, "left_semi").dropDuplicates(keys).select("req_key", *verdicts.columns)


def dedupe_by_key(verdicts: DataFrame) -> DataFrame:
    """One result per request key: the last in capture order. Reads the results twice."""
    return _whole(verdicts, _last(verdicts))


def rules_equal(a: Column, b: Column) -> Column:
    """Same number of rule ids, and every id of ``b`` among those of ``a``."""
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(b, a)) == 0)


def _side(verdicts: DataFrame, side: int) -> DataFrame:
    first = F.try_element_at("rules_triggered", F.lit(1))
    return with_key(verdicts).select(
        "req_key",
        F.lit(side).alias("side"),
        _order().alias("o"),
        F.struct(
            "req_id", "method", "url",
            F.transform("rules_triggered", lambda t: t["id"]).alias("rules"),
            F.concat(F.lit("Rule "), first["id"], F.lit(": "), first["msg"]).alias("first_rule"),
        ).alias("r"),
    )


def last_by_key(verdicts: DataFrame) -> DataFrame:
    """``req_key, r``: the last result of every request, as far as a comparison needs it."""
    return _side(verdicts, 1).groupBy("req_key").agg(F.max_by("r", "o").alias("r"))


def diff_keyed(k1: DataFrame, k2: DataFrame) -> DataFrame:
    """``diff_runs`` of two runs given by ``last_by_key``. Where both are stored in the same buckets, nothing is shuffled."""
    sides = [k.select("req_key", F.col("r").alias(f"r{s}")) for s, k in ((1, k1), (2, k2))]
    return _changes(sides[0].join(sides[1], "req_key", "full_outer"))


def diff_runs(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Requests blocked only in the second run (``added``), only in the first (``removed``),
    or in both by other rules (``modified``)."""
    both = _side(v1, 1).unionByName(_side(v2, 2))
    last = both.groupBy("req_key").agg(*[
        F.max_by(F.when(F.col("side") == s, F.col("r")), F.when(F.col("side") == s, F.col("o"))).alias(f"r{s}")
        for s in (1, 2)
    ])
    return _changes(last)


def _changes(last: DataFrame) -> DataFrame:
    """Changes from ``req_key, r1, r2``, the last results on both sides."""
    kind = (
        F.when(F.col("r1").isNull(), F.lit("added"))
        .when(F.col("r2").isNull(), F.lit("removed"))
        .when(~rules_equal(F.col("r1.rules"), F.col("r2.rules")), F.lit("modified"))
    )
    return (
        last.withColumn("diff_type", kind)
        .where(F.col("diff_type").isNotNull())
        .select(
            "req_key", "diff_type",
            F.coalesce("r1.method", "r2.method").alias("method"),
            F.coalesce("r1.url", "r2.url").alias("url"),
            F.col("r1.rules").alias("rules1"), F.col("r2.rules").alias("rules2"),
            F.when(F.col("r1").isNotNull(), F.col("r1.first_rule")).otherwise(F.col("r2.first_rule")).alias("first_rule"),
            F.col("r1.req_id").alias("req_id1"), F.col("r2.req_id").alias("req_id2"),
        )
    )


def _only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks; keys are made unique before they meet, and rows come last.

    The places of the rows are written down first: where they are few, Spark plans to send
    them to the rows, and no body is shuffled.
    """
    keys = with_key(right).select("req_key").distinct()
    return _whole(left, written(_last(left).join(keys, "req_key", "left_anti")))


def added(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Results of the second run whose request the first run did not block."""
    return _only_in(v2, v1)


def removed(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Results of the first run whose request the second run did not block."""
    return _only_in(v1, v2)


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: total, added, removed, modified."""
    return diff.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("diff_type") == kind).alias(kind) for kind in MARKS],
    )


def diff_titles(diff: DataFrame) -> DataFrame:
    """List entries: mark, method and URL, and what the mark means."""
    kind = F.col("diff_type")
    return diff.select(
        "req_key", "diff_type",
        F.concat_ws(" ", _choose(kind, MARKS), F.col("method"), F.col("url")).alias("title"),
        _choose(kind, MEANINGS).alias("meaning"),
    )


def diff_details(diff: DataFrame, v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Both whole results of every change next to each other; NULL means not blocked.

    Results are looked up by key, side and id. The id spreads a hot key over the tasks.
    The changes are written down first, so that few of them are sent to the results and only
    changed results are shuffled. Both runs are read a second time here, so give it stored ones.
    """
    wanted = diff.select(
        "req_key", "diff_type", "method", "url",
        F.explode(F.array(
            F.struct(F.lit(1).alias("side"), F.col("req_id1").alias("req_id")),
            F.struct(F.lit(2).alias("side"), F.col("req_id2").alias("req_id")),
        )).alias("w"),
    ).select("req_key", "diff_type", "method", "url", "w.*").where(F.col("req_id").isNotNull())
    shown = ["headers", "body", "client_ip", "rules_triggered", "interruption", "logs"]
    full = with_key(v1).withColumn("side", F.lit(1)).unionByName(with_key(v2).withColumn("side", F.lit(2)))
    full = full.select("req_key", "side", "req_id", _order().alias("o"), F.struct("req_id", *shown).alias("r"))
    found = full.join(written(wanted), ["req_key", "side", "req_id"])
    sides = found.groupBy("req_key", "diff_type", "method", "url").agg(*[
        F.max_by(F.when(F.col("side") == s, F.col("r")), F.when(F.col("side") == s, F.col("o"))).alias(f"result{s}")
        for s in (1, 2)
    ])
    return sides.withColumn("mark", _choose(F.col("diff_type"), MARKS))


def diff_group_by_type(diff: DataFrame) -> DataFrame:
    return (
        diff.groupBy(_choose(F.col("diff_type"), GROUPS).alias("key"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")
    )


def diff_rule_key() -> Column:
    """First rule of side 1, or of side 2 where there is no side 1."""
    return placeholder(F.col("first_rule"), "No rules")


def diff_group_by_rule(diff: DataFrame) -> DataFrame:
    return diff.groupBy(diff_rule_key().alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")
