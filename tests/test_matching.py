from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from fixtures import (
    CAPTURE_1, CAPTURE_2, CORPUS, DIRECTIVES_2, DIRECTIVES_6, DIRECTIVES_40, NDJSON, PATTERN_RULES, directive,
    write_capture, write_ndjson,
)
from reqsieve.operators import coverage, matching, reports
from reqsieve.plans import tables as T
from reqsieve.sources import capture, corpus, ndjson, requests
from reqsieve.sources.rules import Rule, load_rules, rules_hash

PATTERNS = [
    Rule(i + 1, r["id"], r["name"], r["pattern"], location=r["location"], action=r["action"], severity=r["severity"], tags=tuple(r["tags"]))
    for i, r in enumerate(PATTERN_RULES["rules"])
]


def traffic(spark, *rows):
    """(method, url, headers, body) as requests."""
    df = spark.createDataFrame(list(rows), "m string, p string, h map<string,string>, b string")
    return requests.map_columns(df, {"method": "m", "path": "p", "headers": "h", "body": "b"})


def ids(row):
    return [t.id for t in row.rules_triggered]


def blocked(verdicts):
    return sorted((r.method, r.url, r.client_ip, ",".join(ids(r))) for r in verdicts.where("blocked").collect())


# Recorded outcomes.


def test_pattern_rules_over_json_lines(spark, tmp_path):
    verdicts = matching.analyze(ndjson.scan_ndjson(spark, write_ndjson(tmp_path / "t.custom")), PATTERNS)
    assert reports.totals(verdicts).first().asDict() == {"total_requests": 4, "blocked_requests": 3}
    assert blocked(verdicts) == [
        ("GET", "http://example.com/search?q=<script>alert(1)</script>", "192.168.1.100", "1001"),
        ("GET", "http://example.com/user?id=1' OR '1'='1", "172.16.0.25", "1002"),
        ("POST", "http://example.com/comment", "10.0.0.50", "1001"),
    ]
    row = verdicts.where("method = 'POST'").first()
    assert row.logs == "[HIGH] Rule 1001: XSS Detection\n" and row.interruption.asDict() == {"action": "deny", "status": 403}
    assert row.rules_triggered[0].tags == ["xss", "injection"] and row.body == NDJSON[2]["body"]


def test_directive_rules_over_json_lines(spark, tmp_path):
    verdicts = matching.analyze(ndjson.scan_ndjson(spark, write_ndjson(tmp_path / "t.custom")), DIRECTIVES_6)
    assert reports.totals(verdicts).first().asDict() == {"total_requests": 4, "blocked_requests": 2}
    assert [r[3] for r in blocked(verdicts)] == ["1", "2"]
    assert {r.logs for r in verdicts.where("blocked").collect()} == {
        "[EMERGENCY] Rule 1: XSS Attack Detected\n", "[EMERGENCY] Rule 2: SQL Injection Detected\n"}
    always = matching.analyze(ndjson.scan_ndjson(spark, str(tmp_path / "t.custom")), DIRECTIVES_6, body_visibility="always")
    assert [r[3] for r in blocked(always)] == ["1", "2", "5"]


@pytest.mark.parametrize("lines, rules, url, rule", [
    (CAPTURE_1, DIRECTIVES_6, "/test?param=<script>alert(1)</script>", "1"),
    (CAPTURE_2, DIRECTIVES_6, "/test?param=../../../etc/passwd", "3"),
    (CAPTURE_2, DIRECTIVES_2, "/test?param=../../../etc/passwd", "3"),
])
def test_directive_rules_over_captures(spark, tmp_path, lines, rules, url, rule):
    verdicts = matching.analyze(capture.scan_capture(spark, write_capture(tmp_path / "t.gor", lines)), rules)
    assert reports.totals(verdicts).first().asDict() == {"total_requests": 2, "blocked_requests": 1}
    assert blocked(verdicts) == [("GET", url, "", rule)]


# Directive rules.


def test_engine_cases(spark):
    rule = directive(1, "1", "ARGS", "contains", "<script>", "XSS Attack")
    form = {"Content-Type": "application/x-www-form-urlencoded"}
    rows = traffic(spark, ("GET", "http://example.com/test?param=<script>alert(1)</script>", {}, ""),
                   ("GET", "http://example.com/test?param=hello", {}, ""),
                   ("POST", "/api", form, "data=%3Cscript%3E"), ("POST", "/api", {}, "data=<script>"))
    assert [(r.blocked, ids(r)) for r in matching.match_directives(rows, [rule]).collect()] == [
        (True, ["1"]), (False, []), (True, ["1"]), (False, [])]
    assert [r.blocked for r in matching.match_directives(rows, [rule], body_access=False).collect()] == [True, False, False, False]


def test_big_rule_set_over_the_corpus(spark, tmp_path):
    (tmp_path / "attacks.http").write_text(CORPUS)
    found = corpus.scan_attack_corpus(spark, str(tmp_path))
    verdicts = matching.analyze(found, DIRECTIVES_40)
    for row in verdicts.collect():
        expected = row.title.rsplit(" ", 1)[1]
        assert ids(row) == ([] if expected == "none" else [expected]), row.title
    labels = found.select("req_id", "category", F.lit(True).alias("attack")).where("not title like '% none'").unionByName(
        found.select("req_id", "category", F.lit(False).alias("attack")).where("title like '% none'"))
    got = {r.attack: (r.requests, r.blocked, r.expected_rate) for r in coverage.coverage(labels, verdicts).collect()}
    assert got == {True: (10, 10, 1.0), False: (4, 0, 1.0)}
    assert coverage.false_positive_rate(labels, verdicts).first().asDict() == {"false_positive_rate": 0.0, "miss_rate": 0.0}


def test_phases_and_first_deny(spark):
    def rule(ord, phase, action, pattern, severity=""):
        return Rule(ord, f"r{ord}", "m", pattern, dialect="directive", variable="REQUEST_URI", operator="contains",
                    phase=phase, action=action, status=400 + ord, severity=severity)

    rules = [rule(1, 2, "deny", "a"), rule(2, 2, "log", "b", "4"), rule(3, 1, "log", "a", "notice"), rule(4, 2, "deny", "b", "9")]
    got = {r.url: r for r in matching.match_directives(
        traffic(spark, ("GET", "/a", {}, ""), ("GET", "/b", {}, ""), ("GET", "/ab", {}, ""), ("GET", "/", {}, "")), rules).collect()}
    assert {u: ids(r) for u, r in got.items()} == {"/a": ["r3", "r1"], "/b": ["r2", "r4"], "/ab": ["r3", "r1"], "/": []}
    assert got["/b"].logs == "[WARNING] Rule r2: m\n[UNKNOWN] Rule r4: m\n"
    assert got["/ab"].interruption.asDict() == {"action": "deny", "status": 401} and got["/"].interruption is None
    assert got["/a"].rules_triggered[0].severity == "NOTICE"


def test_header_selector_and_absent_header(spark):
    rules = [directive(1, "1", "REQUEST_HEADERS", "rx", "^$|x", selector="content-type"), directive(2, "2", "REQUEST_HEADERS", "streq", "y")]
    rows = traffic(spark, ("GET", "/", {"content-TYPE": "axb"}, ""), ("GET", "/", {}, ""), ("GET", "/", {"A": "y", "B": "z"}, ""))
    assert [ids(r) for r in matching.match_directives(rows, rules).collect()] == [["1"], [], ["2"]]


def test_empty_rule_sets(spark):
    rows = traffic(spark, ("GET", "/", {}, ""))
    for verdicts in (matching.match_patterns(rows, []), matching.match_directives(rows, [])):
        row = verdicts.first()
        assert (row.blocked, row.rules_triggered, row.interruption, row.logs) == (False, [], None, "")
    assert matching.match_pairs(rows, []).count() == 0


@pytest.mark.parametrize("rules", [
    [directive(1, "1", "RESPONSE_BODY", "rx", "x")], [directive(1, "1", "ARGS", "le", "x")],
    [Rule(1, "1", "", "x", location="url"), directive(2, "2", "ARGS", "rx", "x")],
])
def test_unknown_rules_are_refused(spark, rules):
    with pytest.raises(ValueError):
        matching.analyze(traffic(spark, ("GET", "/", {}, "")), rules)


# Pattern rules.


def test_every_rule_is_tested_and_log_rules_do_not_block(spark):
    rules = [Rule(1, "l", "log it", "a", location="url", action="log", severity="LOW"), Rule(2, "b", "block it", "b", location="body", action="block", severity="HIGH"),
             Rule(3, "x", "nowhere", ".", location="cookies", action="block"), Rule(4, "h", "value", "^v$", location="headers", action="block")]
    got = [(r.blocked, ids(r), r.logs) for r in matching.match_patterns(
        traffic(spark, ("GET", "/a", {}, ""), ("GET", "/a", {"v": "w"}, "b"), ("GET", "/", {"k": "v", "z": "w"}, "")), rules).collect()]
    assert got == [(False, ["l"], "[LOW] Rule l: log it\n"), (True, ["l", "b"], "[LOW] Rule l: log it\n[HIGH] Rule b: block it\n"),
                   (True, ["h"], "[] Rule h: value\n")]


def test_against_brute_force(spark, sf_dir):
    """All verdicts of the given traffic, recomputed one by one."""
    found = T.requests(spark, sf_dir)
    want = {}
    for r in found.select("req_id", "url", "body", "headers").collect():
        want[r.req_id] = [
            rule.id for rule in T.RULES_V1
            if any(re.search(rule.pattern, v) for v in {
                "url": [r.url], "body": [r.body], "headers": list(r.headers.values()), "all": [r.url, r.body, *r.headers.values()],
            }[rule.location])
        ]
    got = {r.req_id: ids(r) for r in matching.analyze(found, T.RULES_V1).select("req_id", "rules_triggered").collect()}
    assert got == want
    pairs = matching.match_pairs(found, T.RULES_V1).collect()
    assert sorted((r.req_id, r.rule_id) for r in pairs) == sorted((k, i) for k, v in want.items() for i in v)


def test_known_hit_counts(spark, sf_dir):
    if not sf_dir.endswith("sf0.001"):
        pytest.skip("counts are for the smallest scale")
    hits = {r.rule_id: r["count"] for r in matching.match_pairs(T.requests(spark, sf_dir), T.RULES_V1).groupBy("rule_id").count().collect()}
    assert hits == {"1002": 10, "1003": 5, "1004": 201, "1005": 120, "1007": 50, "1008": 3}
    assert reports.totals(T.verdicts(spark, sf_dir, T.RULES_V1)).first().blocked_requests == 209
    assert reports.totals(T.verdicts(spark, sf_dir, T.RULES_V2)).first().blocked_requests == 135


# Plans.


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matching_is_narrow(spark, sf_dir):
    plan = plan_of(matching.analyze(T.requests(spark, sf_dir), T.RULES_V1).where("blocked"))
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_matching_runs_once_below_a_filter(spark, sf_dir):
    plan = plan_of(matching.analyze(T.requests(spark, sf_dir), [T.RULES_V1[7]]).where("blocked").select("req_id", "rules_triggered", "logs"))
    assert plan.count("licen[sc]e") == len(re.findall("Generate stack", plan))


def test_bodies_are_not_read_for_url_rules(spark, sf_dir):
    plan = plan_of(matching.match_pairs(T.requests(spark, sf_dir), [T.RULES_V1[3]]))
    assert "html" not in plan and ",text" not in plan


def test_spread_only_when_needed(spark, sf_dir, monkeypatch):
    few = T.raw_requests(spark, sf_dir)
    assert 1 < requests.spread(few).rdd.getNumPartitions() <= 4
    assert requests.spread(few, 3).rdd.getNumPartitions() == 3
    shuffled = few.groupBy("host").count()
    assert requests.spread(shuffled) is shuffled
    assert requests.spread(few).count() == few.count()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        many = T.raw_requests(spark, sf_dir)
        assert requests.spread(many) is many
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_rules(spark, sf_dir):
    rules = [Rule(i, f"r{i}", "m", f"/error[?]user={i}&|zz{i}[0-9]", location="all", action="block") for i in range(150)]
    hits = matching.match_pairs(T.requests(spark, sf_dir), rules)
    want = T.requests(spark, sf_dir).where("path = '/error' and cast(regexp_extract(url, 'user=(\\\\d+)', 1) as int) < 150").count()
    assert hits.count() >= want > 0


def _directive(ord, variable, pattern, phase=2, selector="", chain_to=None, operator="contains"):
    return Rule(ord, f"d{ord}", "m", pattern, dialect="directive", variable=variable, selector=selector, operator=operator,
                phase=phase, action="deny", chain_to=chain_to)


def test_phase_one_sees_no_body(spark):
    rows = spark.createDataFrame([("POST", "/?q=one", "a=two", {"Content-Type": "application/x-www-form-urlencoded"})],
                                 "method string, url string, body string, headers map<string,string>")
    post = requests.map_columns(rows, {"method": "method", "path": "url", "body": "body", "headers": "headers"})

    def blocked(*rules):
        return matching.match_directives(post, rules).first().blocked

    assert blocked(_directive(1, "ARGS", "one", 1)) and blocked(_directive(1, "ARGS", "two"))
    assert not blocked(_directive(1, "ARGS", "two", 1)) and not blocked(_directive(1, "REQUEST_BODY", "two", 1))
    assert blocked(_directive(1, "REQUEST_BODY", "two")) and not blocked(_directive(1, "ARGS", "one", 1, chain_to=2), _directive(2, "REQUEST_BODY", "two"))


def test_repeated_headers_count_one_by_one(spark, tmp_path):
    path = tmp_path / "t.gor"
    path.write_text("1 " + "a" * 40 + " 1 1\nGET / HTTP/1.1\r\nX-A: foo\r\nx-a: bar\r\n\r\n\n🐵🙈🙉\n", newline="")
    found = capture.scan_capture(spark, str(path))
    for rule in (_directive(1, "REQUEST_HEADERS", "foo", 1, "X-A", operator="streq"), _directive(1, "REQUEST_HEADERS", "bar", 1, operator="streq")):
        assert matching.match_directives(found, [rule]).first().blocked
    assert not matching.match_directives(found, [_directive(1, "REQUEST_HEADERS", "foo, bar", 1, "X-A")]).first().blocked


def test_chains_that_never_end_and_bad_patterns(spark):
    with pytest.raises(ValueError, match="never ends"):
        load_rules([_directive(1, "ARGS", "a", chain_to=2), _directive(2, "ARGS", "a", chain_to=1)])
    with pytest.raises(ValueError, match="does not exist"):
        load_rules([_directive(1, "ARGS", "a", chain_to=9)])
    with pytest.raises(ValueError, match="rule r1"):
        load_rules([Rule(1, "r1", "m", "(")])


def test_options_are_part_of_the_identity():
    rules = [_directive(1, "REQUEST_BODY", "a")]
    assert rules_hash(rules) == rules_hash(rules, body_visibility="form") != rules_hash(rules, body_visibility="always")
