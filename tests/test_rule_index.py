"""Many rules as rows, against the folded form and by looking at the plan."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reqsieve.functions.grams import PLACES, found_grams, grams_of, long_grams_of, place
from reqsieve.functions.regex import is_plain, needed_texts
from reqsieve.operators import rule_index
from reqsieve.operators.matching import match_pairs
from reqsieve.plans.registry import QUERIES
from reqsieve.sources.requests import map_columns
from reqsieve.sources.rules import Rule

WORDS = ["alpha", "Kilo", "SHELL", "..%2f", "etc", "passwd", "<script>", "é", "K", "ſ", "x", "union", "select", "1=1", "\n", "日本"]
COLUMNS = {c: c for c in ("id", "method", "path", "headers", "body")}


def traffic(spark, n=300):
    draw = random.Random(2)
    text = lambda k: " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, k)))
    rows = [(f"r{i % (n - 20)}", "GET", "/" + draw.choice(["a", "etc", "x?q=union"]), '{"User-Agent":"%s","X":"a,b"}' % draw.choice(["shell", "kilo", ""]),
             "the same body: shell kilo" if draw.random() < 0.3 else text(12)) for i in range(n)]
    return map_columns(spark.createDataFrame(rows, "id string, method string, path string, headers string, body string"), COLUMNS)


def rules(n=250):
    draw = random.Random(3)
    kinds = ["{0}", "(?i:{0})", "{0}|{1}", "{0}.{{0,20}}{1}", "(?i){0}", "[0-9]", "^$", "(?:{0})", "^/a", "(?i:{0}|{1})", "x?"]
    quote = lambda w: "".join("\\" + c if c in ".%<>=" and c in "." else c for c in w)
    out = []
    for i in range(n):
        a, b = (quote(draw.choice(WORDS)) for _ in range(2))
        operator = draw.choice(["rx"] * 8 + ["contains", "streq"])
        pattern = draw.choice(kinds).format(a, b) if operator == "rx" else draw.choice([draw.choice(WORDS), "/etc", "shell", "the same body: shell kilo"])
        out.append(Rule(i, f"id{i}", "m", pattern, location=draw.choice(["url", "body", "headers", "all", "nowhere"]), operator=operator, action=draw.choice(["log", "block"])))
    return out


def test_same_pairs_as_the_folded_form(spark):
    requests, some = traffic(spark), rules()
    want = sorted(map(tuple, match_pairs(requests, some).collect()))
    got = sorted(map(tuple, rule_index.match_many(requests.repartition(3), some).collect()))
    assert got == want and len({r[1] for r in want}) > 100


def test_rules_are_no_plan_text(spark):
    found = rule_index.match_many(traffic(spark), [Rule(i, f"id{i}", "m", f"needle{i}|shell", location="body") for i in range(400)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "needle" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.select("ord").distinct().count() == 400


def test_only_candidates_are_tested(spark):
    requests = traffic(spark)
    indexed = rule_index.index_rules(spark.createDataFrame(
        [(1, "a", "passwd", "body"), (2, "b", "neverthere", "body"), (3, "c", "[0-9]", "url"), (4, "d", "x", "nowhere")], "ord int, id string, pattern string, location string"))
    pairs = rule_index.candidates(requests, indexed)
    bodies = [r.body for r in requests.collect()]
    by = {r.ord: r["count"] for r in pairs.groupBy("ord").count().collect()}
    distinct = requests.select("url", "body", F.to_json("headers")).distinct().count()
    assert set(by) == {1, 3} and by[3] == distinct and by[1] <= sum("passwd" in b for b in bodies)


def test_bad_rules_are_named(spark):
    for rule, said in ((Rule(1, "bad", "m", "(", location="url", operator="near"), "near"), (Rule(1, "bad", "m", "(?=x)", location="url"), "rule bad")):
        with pytest.raises(Exception, match=said):
            rule_index.match_many(traffic(spark, 30), [rule])


def test_no_rules_and_no_requests(spark):
    requests = traffic(spark, 30)
    assert rule_index.match_many(requests, []).count() == 0
    assert rule_index.match_many(requests.limit(0), rules(20)).count() == 0


@pytest.mark.parametrize("literal", [b"", b"a", b"AbC", b"abcd", b"abcdefgh", "é日".encode()])
def test_grams(literal):
    texts = [None, "", "xxABCDEFGHxx", "abc", "é日", "ab", "c", "a" * 5]
    wanted = np.zeros(PLACES, bool)
    grams = grams_of(literal)
    wanted[place(np.array(grams))] = True
    held = {}
    for rows, codes in found_grams(pa.array(texts), wanted):
        for r, c in zip(rows.tolist(), codes.tolist()):
            held.setdefault(r, set()).add(c)
    for i, text in enumerate(texts):
        data = (text or "").encode().lower()
        want = {g for g in grams if (g & 0xFFFFFFFF).to_bytes(4, "little")[: g >> 32] in data}
        assert held.get(i, set()) & set(grams) == want
        if literal.lower() in data:
            assert want == set(grams)


def test_queries_against_plain_rules(spark, sf_dir):
    assert QUERIES["match_many"](spark, sf_dir).count() > 0


def test_candidates_have_all_literals(spark):
    """Words that each are in many requests make candidates only where they meet."""
    texts = ["alpha beta", "beta gamma", "alpha gamma", "gamma beta", "alpha beta gamma", ""] * 5
    requests = map_columns(spark.createDataFrame(
        [(f"r{i}", "GET", f"/{i}", "", t) for i, t in enumerate(texts)], "id string, method string, path string, headers string, body string"), COLUMNS)
    some = [Rule(1, "a", "m", "alpha.*gamma", location="body"), Rule(2, "b", "m", "gamma[ ]+beta|nowhere.*alpha", location="body"),
            Rule(3, "c", "m", "(?i:ALPHA BETA G)", location="all")]
    table = spark.createDataFrame([(r.ord, r.id, r.action, r.location, r.operator, r.pattern) for r in some],
                                  "ord int, id string, action string, location string, operator string, pattern string")
    pairs = rule_index.candidates(requests, rule_index.index_rules(table))
    assert {r.ord: r["count"] for r in pairs.groupBy("ord").count().collect()} == {1: 10, 2: 15, 3: 5}
    assert sorted(map(tuple, rule_index.match_many(requests, some).collect())) == sorted(map(tuple, match_pairs(requests, some).collect()))


@pytest.mark.parametrize("literal", [b"abcde", b"ABCDEF", b"abcdefgh", "日本é".encode()])
def test_long_grams(literal):
    texts = ["", "xxABCDEFGHxx", "abcde", "abcd", "é日日本é", "abcdef", "ab" * 30_000 + "abcdefgh"]
    wanted, grams = np.zeros(PLACES, bool), long_grams_of(literal)
    wanted[place(np.array(grams))] = True
    held = {}
    for rows, codes in found_grams(pa.array(texts), wanted, {g >> 32 for g in grams}):
        for r, c in zip(rows.tolist(), codes.tolist()):
            held.setdefault(r, set()).add(c)
    assert min(g >> 32 for g in grams) > 4
    assert [set(grams) <= held.get(i, set()) for i in range(len(texts))] == [literal.lower() in t.encode().lower() for t in texts]


def test_needed_texts_are_in_all_matches():
    draw, seen = random.Random(4), 0
    parts = ["a", "b", "ab", "ba", "aa", "[ab]", "[ ,]", "[ab ]", "(?:ab)", "(a|b)", "(?:b a)", ".", "[^b]", "[a-c]"]
    for _ in range(3000):
        pattern = "".join(draw.choice(parts) + draw.choice(["", "", "", "+", "*", "?", "{2}", "{1,3}", "{0}", "{3,}", "+?"]) for _ in range(draw.randint(1, 5)))
        pattern += draw.choice(["", "", "|" + draw.choice(parts) + "b"])
        needed, text = needed_texts(pattern), "".join(draw.choice("ab ,") for _ in range(draw.randint(0, 12)))
        if needed and re.search(pattern, text):
            seen += 1
            assert any(all(any(t in text for t in texts) for texts in lists) for lists in needed), (pattern, text, needed)
    assert seen > 300


@pytest.mark.parametrize("pattern,needed,plain", [
    ("lo[ck]al", [[["lo"], ["al"], ["local", "lokal"]]], True), ("(?:ci) de[ a-z]*Ci", [[["ci de"], ["Ci"]]], True),
    ("a{3}b", [[["b"], ["ab"]]], True), ("x?", None, True), ("(?i:x)abc", [[["abc"]]], False), ("(?i)abc", None, False),
    ("^/a", [[["/a"]]], False), ("(ab)+cd", [[["cd"]]], False), ("[]a]b", [[["b"]]], False), ("a)b", None, False), ("é.", [[["é"]]], False)])
def test_needed_texts(pattern, needed, plain):
    assert needed_texts(pattern) == needed and is_plain(pattern) is plain


def made_requests(spark, texts):
    return map_columns(spark.createDataFrame(
        [(f"r{i}", "GET", f"/{i}", '{"A":"%s","B":"x y"}' % t, t) for i, t in enumerate(texts)],
        "id string, method string, path string, headers string, body string"), COLUMNS)


def test_only_requests_that_hold_neighbours_are_candidates(spark):
    """Frequent words that are all in a request, though not side by side, make no candidate."""
    requests = made_requests(spark, ["the one in", "the, in one", "in the one", "in  the", "one"])
    some = [Rule(1, "a", "m", "the[ ,.]+in", location="body"), Rule(2, "b", "m", "(?:in) the[ a-z]*one", location="body")]
    table = spark.createDataFrame([(r.ord, r.id, r.action, r.location, r.operator, r.pattern) for r in some],
                                  "ord int, id string, action string, location string, operator string, pattern string")
    indexed = rule_index.index_rules(table)
    texts = requests.select("req_id", "url", "body").withColumn("__values", F.lit(""))
    [block] = rule_index._rule_blocks(indexed, "needs")
    for search, sure in ((False, 0), (True, 1)):
        found = sorted((r.req_id, x >> 1, x & 1) for r in rule_index._with_candidates(texts, block, search).collect() for x in r.ords)
        assert found == [("r1", 1, sure), ("r2", 2, sure)]


def test_requests_are_not_shuffled(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = rule_index.match_many(traffic(spark), rules())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_rules_in_many_blocks_and_with_one_number(spark, monkeypatch):
    monkeypatch.setattr(rule_index, "BLOCK_GRAMS", 40)
    texts = ["alpha beta", "beta, alpha", "gamma", "alpha  beta gamma", "x"]
    patterns = ["alpha beta", "alpha[ ,]+beta", "beta|gamma", "(?i:GAMMA)", "beta[ ,.]+alpha", "a\ny", "y\nalpha", "x{2000}|gam+a", "x y"]
    some = [Rule(i // 2 - 2, f"id{i}", "m", p, location=["body", "all", "headers"][i % 3]) for i, p in enumerate(patterns)]
    requests = made_requests(spark, texts)
    want = sorted((f"r{k}", r.ord, r.id, r.action) for k, t in enumerate(texts) for r in some
                  if any(re.search(r.pattern, v) for v in {"body": [t], "headers": [t, "x y"], "all": [t, f"/{k}", "x y"]}[r.location]))
    blocks = len(list(rule_index._rule_blocks(rule_index.index_rules(rule_index.as_rule_table(spark.createDataFrame(
        [(r.ord, r.id, r.action, r.location, r.operator, r.pattern) for r in some], "ord int, id string, action string, location string, operator string, pattern string"))), "needs")))
    assert sorted(map(tuple, rule_index.match_many(requests, some).collect())) == want and blocks > 2
