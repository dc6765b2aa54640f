"""Matching requests against rules.

Rules are few and requests are many, so a rule set is folded into the plan: every rule
becomes one predicate, and the predicates together give the array of matching rule
positions of a request. That is a narrow projection: the request row stays where it was
read, bodies are never shuffled, and there is no join. The regexes are literals, compiled
once per task, and the predicates run inside generated code.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.functions.headers import client_ip
from reqsieve.functions.once import once
from reqsieve.functions.regex import matches
from reqsieve.functions.text import SEVERITY_NAMES
from reqsieve.functions.urls import extract_args, is_form, without_fragment
from reqsieve.schemas import INTERRUPTION, REQUEST_COLUMNS, TRIGGERED
from reqsieve.sources.rules import Rule, load_rules

BODY_VISIBILITY = ("form", "always", "never")


def test(value: Column, operator: str, pattern: str) -> Column:
    """One rule operator on one value."""
    if operator == "rx":
        return matches(value, pattern)
    if operator == "contains":
        return F.contains(value, F.lit(pattern))
    if operator == "streq":
        return value == F.lit(pattern)
    raise ValueError(f"unknown rule operator {operator!r}")


def any_value(headers: Column, check: Callable[[Column], Column]) -> Column:
    """Does any header value pass? Names are not looked at."""
    return F.exists(F.map_values(headers), check)


def pattern_condition(rule: Rule) -> Column:
    """Predicate of a pattern rule; an unknown location never matches."""
    def check(value: Column) -> Column:
        return test(value, rule.operator, rule.pattern)

    places = {
        "url": lambda: check(F.col("url")),
        "body": lambda: check(F.col("body")),
        "headers": lambda: any_value(F.col("headers"), check),
    }
    if rule.location == "all":
        return reduce(or_, [place() for place in places.values()])
    return places[rule.location]() if rule.location in places else F.lit(False)


def _one_directive(rule: Rule, phase: int) -> Column:
    """Condition of one rule; in phase 1 the body has not been read yet."""
    def check(value: Column) -> Column:
        return test(value, rule.operator, rule.pattern)

    if rule.variable == "ARGS":
        return F.exists("__args" if phase > 1 else "__query_args", check)
    if rule.variable == "REQUEST_BODY":
        return F.coalesce(check(F.col("__body")), F.lit(False)) if phase > 1 else F.lit(False)
    if rule.variable == "REQUEST_HEADERS":
        if not rule.selector:
            return F.exists(F.flatten(F.map_values("__header_values")), check)
        name = "-".join(part.capitalize() for part in rule.selector.split("-"))
        return F.coalesce(F.exists(F.try_element_at("__header_values", F.lit(name)), check), F.lit(False))
    if rule.variable == "REQUEST_URI":
        return check(F.col("__uri"))
    if rule.variable == "REQUEST_METHOD":
        return check(F.col("method"))
    raise ValueError(f"rule {rule.id}: unknown variable {rule.variable!r}")


def directive_condition(rule: Rule, by_ord: Mapping[int, Rule]) -> Column:
    """Predicate of a directive rule together with the conditions chained to it."""
    conditions, link = [_one_directive(rule, rule.phase)], rule
    while link.chain_to is not None:
        link = by_ord[link.chain_to]
        conditions.append(_one_directive(link, rule.phase))
    return reduce(and_, conditions)


def _positions(conditions: list[Column]) -> Column:
    """Positions of the conditions that hold, ascending.

    ``array_remove`` over a flat array and not ``filter``: higher-order functions leave
    generated code, and would take the predicates below them along.
    """
    if not conditions:
        return F.array().cast("array<int>")
    marks = [F.when(c, F.lit(i)).otherwise(F.lit(-1)) for i, c in enumerate(conditions)]
    return F.array_remove(F.array(*marks), F.lit(-1))


def pattern_hits(rules: list[Rule]) -> Column:
    """Positions of all pattern rules a request matches: every rule is tested."""
    return _positions([pattern_condition(r) for r in rules])


def directive_hits(heads: list[Rule], by_ord: Mapping[int, Rule]) -> tuple[Column, Column]:
    """``(first denying position or NULL, positions of other matching rules)``.

    ``heads`` are in order of evaluation. The first denying rule ends it: denying rules
    are tested one after the other until one matches; of the other rules the ones before
    it count.
    """
    denying = [
        F.when(directive_condition(r, by_ord), F.lit(i)) for i, r in enumerate(heads) if r.action == "deny"
    ]
    first = F.coalesce(*denying, F.lit(None).cast("int")) if denying else F.lit(None).cast("int")
    others = _positions(
        [F.lit(False) if r.action == "deny" else directive_condition(r, by_ord) for r in heads]
        if any(r.action != "deny" for r in heads) else []
    )
    return first, others


def evaluation_order(rules: list[Rule]) -> list[Rule]:
    """Rules that start a chain or stand alone, phase by phase, in rule order inside a phase."""
    chained = {r.chain_to for r in rules if r.chain_to is not None}
    return sorted((r for r in rules if r.ord not in chained), key=lambda r: (r.phase, r.ord))


def with_directive_variables(requests: DataFrame, body_access: bool, body_visibility: str) -> DataFrame:
    """Add what directive rules look at besides the request columns."""
    if body_visibility not in BODY_VISIBILITY:
        raise ValueError(f"body_visibility must be one of {BODY_VISIBILITY}")
    visible = {
        "form": is_form(F.col("headers")), "always": F.lit(True), "never": F.lit(False),
    }[body_visibility if body_access else "never"]
    args = extract_args(F.col("query"), F.col("body"), F.col("headers"), body_access)
    query = extract_args(F.col("query"), F.col("body"), F.col("headers"), body_access=False)
    one_each = F.transform_values("headers", lambda k, v: F.array(v))
    asked = F.contains(without_fragment(F.col("url")), F.lit("?"))
    return requests.withColumns({
        "__args": F.transform(args, lambda a: a["v"]),
        "__query_args": F.transform(query, lambda a: a["v"]),
        "__body": F.when(visible, F.col("body")),
        "__header_values": F.col("header_values") if "header_values" in requests.columns else one_each,
        "__uri": F.concat(F.col("path"), F.when(asked, F.concat(F.lit("?"), F.col("query"))).otherwise(F.lit(""))),
    })


def _constant(rows: list[dict], kind: str) -> Column:
    """Rows as a constant array of structs; the optimizer folds it into one literal."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


def _triggered_constant(rules: list[Rule], severity: Callable[[Rule], str]) -> Column:
    return _constant(
        [{"id": r.id, "msg": r.msg, "severity": severity(r), "tags": r.tags} for r in rules], TRIGGERED
    )


def log_lines(rules_triggered: Column) -> Column:
    """``[SEVERITY] Rule id: msg`` and a line end, for every triggered rule."""
    return F.array_join(
        F.transform(
            rules_triggered,
            lambda t: F.concat(F.lit("["), t["severity"], F.lit("] Rule "), t["id"], F.lit(": "), t["msg"], F.lit("\n")),
        ),
        "",
    )


def _finish(matched: DataFrame, carried: list[str], known: Column, hits: Column,
            blocked: Column, interruption: Column) -> DataFrame:
    """Verdict columns from the hit positions of a request."""
    triggered = F.transform(hits, lambda i: F.element_at(known, i + 1))
    request = [
        client_ip(F.col("headers"), F.col("client_ip")).alias(c) if c == "client_ip" else F.col(c) for c in carried
    ]
    return matched.select(
        *request,
        blocked.alias("blocked"),
        triggered.alias("rules_triggered"),
        F.when(blocked, interruption).cast(INTERRUPTION).alias("interruption"),
        log_lines(triggered).alias("logs"),
    )


def _carried(requests: DataFrame) -> list[str]:
    return REQUEST_COLUMNS + [c for c in requests.columns if c not in REQUEST_COLUMNS]


def match_patterns(requests: DataFrame, rules: DataFrame | Iterable[Rule]) -> DataFrame:
    """Verdicts by pattern rules: all rules are tested, a ``block`` rule blocks with 403."""
    rules = load_rules(rules)
    matched = once(requests, __hits=pattern_hits(rules))
    blocking = [i for i, r in enumerate(rules) if r.action == "block"]
    blocked = F.arrays_overlap("__hits", F.array(*[F.lit(i) for i in blocking])) if blocking else F.lit(False)
    known = _triggered_constant(rules, lambda r: r.severity)
    interruption = F.struct(F.lit("deny").alias("action"), F.lit(403).alias("status"))
    return _finish(matched, _carried(requests), known, F.col("__hits"), blocked, interruption)


def match_directives(
    requests: DataFrame,
    rules: DataFrame | Iterable[Rule],
    body_access: bool = True,
    body_visibility: str = "form",
) -> DataFrame:
    """Verdicts by directive rules: phase by phase, until the first rule that denies.

    ``body_access`` makes form arguments and the request body visible to rules from phase 2 on;
    ``body_visibility`` says which bodies ``REQUEST_BODY`` stands for. Headers are looked at
    value by value where the source has them in ``header_values``.
    """
    rules = load_rules(rules)
    heads = evaluation_order(rules)
    first, others = directive_hits(heads, {r.ord: r for r in rules})
    carried = _carried(requests)
    matched = once(
        with_directive_variables(requests, body_access, body_visibility),
        __first=first, __others=others,
    )
    before = F.filter("__others", lambda i: i < F.coalesce(F.col("__first"), F.lit(len(heads))))
    hits = F.when(F.col("__first").isNull(), before).otherwise(F.array_append(before, F.col("__first")))
    known = _triggered_constant(heads, severity_of_directive)
    outcomes = _constant([{"action": r.action, "status": r.status} for r in heads], INTERRUPTION)
    interruption = F.element_at(outcomes, F.col("__first") + 1)
    return _finish(matched, carried, known, hits, F.col("__first").isNotNull(), interruption)


def severity_of_directive(rule: Rule) -> str:
    """Directive rules carry a severity code or a name; none at all counts as code 0."""
    code = rule.severity or "0"
    if not code.lstrip("-").isdigit():
        return code.upper()
    return SEVERITY_NAMES[int(code)] if 0 <= int(code) < len(SEVERITY_NAMES) else "UNKNOWN"


def match_pairs(requests: DataFrame, rules: DataFrame | Iterable[Rule]) -> DataFrame:
    """One row per request and matching pattern rule: ``req_id, ord, rule_id, action``."""
    rules = load_rules(rules)
    known = _constant(
        [{"ord": r.ord, "rule_id": r.id, "action": r.action} for r in rules],
        "struct<ord:int,rule_id:string,action:string>",
    )
    hits = requests.select("req_id", F.explode(pattern_hits(rules)).alias("hit"))
    return hits.select("req_id", F.element_at(known, F.col("hit") + 1).alias("rule")).select("req_id", "rule.*")


def analyze(requests: DataFrame, rules: DataFrame | Iterable[Rule], **options) -> DataFrame:
    """Verdicts of a traffic source by the rules of either dialect."""
    rules = load_rules(rules)
    dialects = {r.dialect for r in rules}
    if dialects <= {"pattern"}:
        return match_patterns(requests, rules)
    if dialects == {"directive"}:
        return match_directives(requests, rules, **options)
    raise ValueError(f"one rule set, one dialect: {sorted(dialects)}")


def blocked_only(verdicts: DataFrame) -> DataFrame:
    """The verdicts a run keeps."""
    return verdicts.where("blocked")
