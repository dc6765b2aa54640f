"""Rule tables: from JSON rule files, and delivered as rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.functions.regex import to_java
from reqsieve.schemas import PATTERN_RULES, RULE
from reqsieve.sources.uris import resolve_uri


@dataclass(frozen=True)
class Rule:
    """One row of a rule table, on its way into the query plan."""

    ord: int
    id: str
    msg: str
    pattern: str
    dialect: str = "pattern"
    location: str = ""
    variable: str = ""
    selector: str = ""
    operator: str = "rx"
    phase: int = 2
    action: str = "log"
    status: int = 403
    severity: str = ""
    tags: tuple[str, ...] = field(default=())
    chain_to: int | None = None


def scan_rules(spark: SparkSession, path: str) -> DataFrame:
    """Pattern rules of a JSON document ``{"engine": ..., "rules": [...]}``, in file order."""
    document = spark.read.schema(PATTERN_RULES).option("multiLine", True).json(resolve_uri(path))
    values: dict[str, Column] = {
        "ord": F.col("pos") + 1,
        "id": F.col("r.id"),
        "msg": F.col("r.name"),
        "dialect": F.lit("pattern"),
        "location": F.col("r.location"),
        "operator": F.lit("rx"),
        "pattern": F.col("r.pattern"),
        "action": F.col("r.action"),
        "status": F.lit(403),
        "severity": F.col("r.severity"),
        "tags": F.col("r.tags"),
    }
    return document.select(F.posexplode("rules").alias("pos", "r")).select(*rule_columns(values))


def rule_columns(values: dict[str, Column]) -> list[Column]:
    """All rule columns, NULL where nothing is given."""
    columns = []
    for name, kind in (part.split() for part in RULE.replace("\n", " ").split(",")):
        columns.append(values.get(name, F.lit(None)).cast(kind).alias(name))
    return columns


def as_rule_table(df: DataFrame) -> DataFrame:
    """A table with some of the rule columns, completed to all of them."""
    return df.select(*rule_columns({c: F.col(c) for c in df.columns}))


def scan_directive_rules(spark: SparkSession, path: str) -> DataFrame:
    """Directive rules as rows, from a CSV (with header) or parquet file.

    In CSV, ``tags`` are separated by spaces.
    """
    path = resolve_uri(path)
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        if "tags" in rows.columns:
            rows = rows.withColumn("tags", F.split("tags", " "))
    else:
        rows = spark.read.parquet(path)
    return as_rule_table(rows.withColumn("dialect", F.lit("directive")))


def load_rules(rules: DataFrame | Iterable[Rule]) -> list[Rule]:
    """A rule table as the list the matchers fold into the plan, in rule order.

    The table is configuration: it becomes part of the plan, so all of it passes the
    driver. Patterns that do not compile are reported with the id of their rule.
    """
    if isinstance(rules, DataFrame):
        defaults = asdict(Rule(0, "", "", ""))
        loaded = []
        for row in as_rule_table(rules).orderBy("ord").collect():
            given = {k: v for k, v in row.asDict().items() if v is not None}
            given["tags"] = tuple(given.get("tags", ()))
            loaded.append(Rule(**{**defaults, **given}))
    else:
        loaded = sorted(rules, key=lambda r: r.ord)
    _check_chains(loaded)
    _compile(SparkSession.active(), loaded)
    return loaded


def _check_chains(rules: list[Rule]) -> None:
    """Every chain names rules that are there, and ends."""
    by_ord = {r.ord: r for r in rules}
    for rule in rules:
        seen, link = {rule.ord}, rule
        while link.chain_to is not None:
            if link.chain_to not in by_ord:
                raise ValueError(f"rule {link.id}: chained to rule {link.chain_to}, which does not exist")
            if link.chain_to in seen:
                raise ValueError(f"rule {rule.id}: its chain never ends")
            link = by_ord[link.chain_to]
            seen.add(link.ord)


#: Patterns that have been compiled once already.
_COMPILED: set[str] = set()


def _compile(spark: SparkSession, rules: list[Rule]) -> None:
    def fail(rule: Rule, error: Exception) -> None:
        raise ValueError(f"failed to compile pattern for rule {rule.id}: {error}") from error

    regexes = []
    for rule in rules:
        if rule.operator == "rx" and rule.pattern not in _COMPILED:
            try:
                regexes.append((rule, to_java(rule.pattern)))
            except ValueError as error:
                fail(rule, error)
    if not regexes:
        return
    one = spark.range(1)
    try:
        one.select(*[F.lit("").rlike(regex) for _, regex in regexes]).collect()
    except Exception:
        for rule, regex in regexes:
            try:
                one.select(F.lit("").rlike(regex)).collect()
            except Exception as error:
                fail(rule, error)
        raise
    _COMPILED.update(rule.pattern for rule, _ in regexes)


#: How directive rules are matched if nothing is said.
MATCHING_DEFAULTS = {"body_access": True, "body_visibility": "form"}


def rules_hash(rules: Iterable[Rule], **options) -> str:
    """12-character identity of a rule set and of the options it is matched with.

    Options that are left out count with their defaults.
    """
    rows = [asdict(r) for r in sorted(rules, key=lambda r: r.ord)]
    text = json.dumps([rows, MATCHING_DEFAULTS | options], sort_keys=True, ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()[:12]
