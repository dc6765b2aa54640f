"""Listings, totals and grouped views over requests and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqsieve.functions.headers import header
from reqsieve.functions.regex import subsequence
from reqsieve.functions.text import body_size, ellipsize, placeholder
from reqsieve.functions.urls import lenient_decode
from reqsieve.session import written


def totals(verdicts: DataFrame) -> DataFrame:
    """One row: requests that entered matching, and blocked ones."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if("blocked").alias("blocked_requests")
    )


def blocked_pct(blocked: Column, total: Column) -> Column:
    """Blocked share in percent, 0 without requests."""
    return F.when(total > 0, blocked * F.lit(100.0) / total).otherwise(F.lit(0.0))


def first_rule_key() -> Column:
    first = F.try_element_at("rules_triggered", F.lit(1))
    return placeholder(F.concat(F.lit("Rule "), first["id"], F.lit(": "), first["msg"]), "No rules")


def ip_key() -> Column:
    return placeholder(F.col("client_ip"), "Unknown IP")


def user_agent_key() -> Column:
    return placeholder(ellipsize(header(F.col("headers"), "User-Agent"), 50, "detail"), "No User-Agent")


#: Points of a found character: for itself, right after the one before it, at the start of a word.
HIT, RUN, START = 1, 6, 4

GROUPINGS = {"rule": first_rule_key, "ip": ip_key, "user-agent": user_agent_key}


def _counted(verdicts: DataFrame, key: Column) -> DataFrame:
    counts = verdicts.where("blocked").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "key")


def group_by_rule(verdicts: DataFrame) -> DataFrame:
    """Blocked requests by the first rule they triggered, biggest group first."""
    return _counted(verdicts, first_rule_key())


def group_by_ip(verdicts: DataFrame) -> DataFrame:
    """Blocked requests by client address, biggest group first."""
    return _counted(verdicts, ip_key())


def group_by_user_agent(verdicts: DataFrame) -> DataFrame:
    """Blocked requests by user agent, biggest group first."""
    return _counted(verdicts, user_agent_key())


def request_label() -> Column:
    """``METHOD url`` and, where known, the address in brackets."""
    address = F.when(F.col("client_ip") != "", F.concat(F.lit(" ["), F.col("client_ip"), F.lit("]")))
    return F.concat(F.col("method"), F.lit(" "), F.col("url"), F.coalesce(address, F.lit("")))


def group_examples(df: DataFrame, key: Column, label: Column, order: list[Column], n: int = 5) -> DataFrame:
    """Per group: its size, its first ``n`` members and how many more there are.

    ``df`` is read twice, so give it stored rows and not an analysis still to be run.
    The size comes from a plain aggregation and the members from a rank filter, which
    Spark applies before the shuffle too: of a group of any size, a task sends ``n`` rows.
    """
    rows = df.select(key.alias("key"), label.alias("label"), F.struct(*order).alias("o"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("o"))).where(F.col("rank") <= n)
    examples = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("e"))
    return counts.join(examples, "key").select(
        "key", "n",
        F.transform("e", lambda e: e["label"]).alias("examples"),
        F.greatest(F.col("n") - n, F.lit(0)).alias("more"),
    )


def verdict_examples(verdicts: DataFrame, by: str = "rule", n: int = 5) -> DataFrame:
    """Blocked requests grouped by ``rule``, ``ip`` or ``user-agent``, with examples."""
    return group_examples(
        verdicts.where("blocked"), GROUPINGS[by](), request_label(), [F.col("req_seq"), F.col("req_id")], n
    )


def _searched(*fields: Column) -> Column:
    """The text that a search looks at: by default method, URL and rule tags."""
    if not fields:
        tags = F.flatten(F.transform("rules_triggered", lambda t: t["tags"]))
        fields = (F.col("method"), F.col("url"), F.array_join(tags, " "))
    return F.concat_ws(" ", *fields)


def search(df: DataFrame, text: str, *fields: Column) -> DataFrame:
    """Rows whose ``fields`` (by default method, URL and rule tags) contain the characters
    of ``text`` in order, in any case."""
    return df.where(subsequence(_searched(*fields), text))


def match_score(value: Column, text: str) -> Column:
    """How well the characters of ``text`` fit into a value, in the best of all ways to find them there in order.

    A found character counts ``HIT``, ``START`` more at the start of a word and ``RUN`` more right after the one found
    before it. One pass over the characters keeps, for each beginning of ``text``, the best score so far (``b``) and
    the best that ends at the last character (``m``). Case does not count; NULL where the characters are not found.
    """
    wanted = text.lower()
    if not wanted:
        return F.when(value.isNotNull(), F.lit(0))
    nothing, steps = F.lit(None).cast("int"), range(1, len(wanted) + 1)

    def step(state: Column, c: Column) -> Column:
        start = F.when(state["in_word"], F.lit(0)).otherwise(F.lit(START))
        fields = [((F.upper(c) != c) | c.between("0", "9")).alias("in_word")]
        for j in steps:
            before = F.lit(0) if j == 1 else F.greatest(state[f"b{j - 1}"], state[f"m{j - 1}"] + RUN)
            found = F.when(c == wanted[j - 1], before + HIT + start)
            fields += [F.greatest(state[f"b{j}"], found).alias(f"b{j}"), found.alias(f"m{j}")]
        return F.struct(*fields)

    empty = F.struct(F.lit(False).alias("in_word"), *[nothing.alias(f"{k}{j}") for j in steps for k in "bm"])
    return F.aggregate(F.split(F.lower(value), ""), empty, step, lambda state: state[f"b{len(wanted)}"])


def search_ranked(df: DataFrame, text: str, n: int, *fields: Column, order: tuple[str, ...] = ("req_seq", "req_id")) -> DataFrame:
    """The ``n`` best matches of a ``search`` with their ``score``, best first, equal scores in the given order.

    Scores are taken of matches only, and a task sends on its ``n`` best rows.
    """
    value = _searched(*fields)
    scored = df.where(subsequence(value, text)).withColumn("score", F.coalesce(match_score(value, text), F.lit(0)))
    return scored.orderBy(F.desc("score"), *order).limit(n)


def limit(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` requests in the given order; 0 is no limit."""
    return df.orderBy(*order).limit(n) if n > 0 else df.orderBy(*order)


def sorted_headers(headers: Column) -> Column:
    """``Name: value`` lines by header name."""
    return F.transform(
        F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )


def numbered(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """Add ``n``, the running number of a row in the given (unique) order.

    Rows are range-partitioned and sorted; a task numbers its own, and the sizes of the parts before it are added. The
    ranges follow the data, and Spark joins small ones. The numbered rows are written down before their parts are counted, so
    the source is read twice: for the ranges, and for the rows. Rows move with all their columns: pass few.
    """
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    rows = written(ranged.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__at", 33), F.col("__at") % (1 << 33)
    sizes = rows.groupBy(part.alias("__part")).agg((F.max(inside) + 1).alias("size"))
    before, offsets = 0, []
    for r in sizes.orderBy("__part").collect():  # one row for each range
        offsets.append((r["__part"], before))
        before += r["size"]
    shifts = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    return rows.withColumn("__part", part).join(shifts, "__part").withColumn("n", F.col("__before") + inside + 1).drop("__at", "__part", "__before")


def list_requests(requests: DataFrame, *order: str, more: bool = False) -> DataFrame:
    """Numbered listing: method, path, host and address; ``more`` adds the whole request, which then moves once."""
    order = order or ("req_seq", "req_id")
    path = lenient_decode(F.col("path"), plus_is_space=False)
    if not more:
        narrow = requests.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(order)], "method", "path", "host", "client_ip")
        return numbered(narrow, *[f"__{i}" for i in range(len(order))]).select(
            "n", "method",
            ellipsize(path, 50).alias("path"),
            ellipsize(placeholder(F.col("host"), "-"), 30).alias("host"),
            placeholder(F.col("client_ip"), "-").alias("client_ip"),
        )
    return numbered(requests, *order).select(
        "n", "method", path.alias("path"), "host", "proto", "client_ip",
        F.col("ts").alias("date"),
        sorted_headers(F.col("headers")).alias("headers"),
        body_size(F.col("body")).alias("body_bytes"),
        "body",
    )
