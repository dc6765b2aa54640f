from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reqsieve.functions import headers, identity, regex, text, urls


def one(spark, column, **values):
    types = {str: "string", int: "int", bool: "boolean", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("pattern, value, found", [
    ("a.c", "a\rc", True),
    ("a.c", "a\nc", False),
    ("end$", "the end", True),
    ("end$", "the end\n", False),
    ("(?m)end$", "the end\nmore", True),
    ("(?m)^more", "the end\nmore", True),
    (r"a\sb", "a\x0bb", False),
    (r"a[\s]b", "a b", True),
    (r"a\Sb", "a\x0bb", True),
    ("[[:alpha:]]{3}", "12abc", True),
    ("[[:alpha:]]{3}", "::[", False),
    ("[^[:digit:]]", "123", False),
    ("[a&&b]+z", "&z", True),
    ("[[]x", "[x", True),
    ("[]]x", "]x", True),
    ("(?P<word>ab)c", "abc", True),
    (r"\$\{jndi:", "${jndi:x", True),
    ("a{,2}", "a{,2}", True),
    ("x{2}", "xx", True),
    (r"\bcat\b", "a cat.", True),
    (r"\bcat\b", "concat", False),
    ("(?i:licen[sc]e)", "LICENSE", True),
    ("(?i:k)", "\u212a", True),
    ("(?i:ask)", "A\u017f\u212a", True),
    ("(?i:DROP\\s+table)", "x drop  TABLE y", True),
    ("(?i)drop table", "Drop Tablet", True),
    ("(?i:drop table)", "droptable", False),
    (r"\pL+\d", "é1", True),
    (r"\p{Greek}", "λ", True),
    (r"\P{Greek}", "λ", False),
    (r"\Qa.b\E", "axb", False),
    (r"\101", "A", True),
    (r"\v", "\n", False),
    ("colou?r", "color", True),
    ("ab*c", "ac", True),
    ("ab|cd*", "c", True),
    ("", "anything", True),
])
def test_patterns_read_as_written(spark, pattern, value, found):
    assert one(spark, regex.matches(F.col("v"), pattern), v=value) is found


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", "a++", "a**", r"\Z", r"(a)\1", "[a", "[[:nope:]]", "(?>a)"])
def test_patterns_outside_the_dialect_are_refused(pattern):
    with pytest.raises(ValueError):
        regex.to_java(pattern)


@pytest.mark.parametrize("pattern, expected", [
    ("spam-farm|cheap-pills", (["spam-farm", "cheap-pills"], True)),
    (r"\.\./|/etc/passwd", (["../", "/etc/passwd"], True)),
    ("^/error[?]", (["/error"], False)),
    ("abc?", (["ab"], False)),
    ("a|b*", None),
    ("(?i)abc", None),
    ("(?i:abc)", None),
    ("(?i:abc).*://", (["://"], False)),
    ("(abc)", None),
    ("(?:a|b)cd", (["cd"], False)),
])
def test_required_literals(pattern, expected):
    assert regex.required_literals(pattern) == expected


_ATOM = st.sampled_from(["a", "b", "ab", "[ab]", ".", "a?", "b*", "(?:a|b)", "(ab)+", "c{2}", "^", "$", r"\.", "|"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_ATOM, min_size=1, max_size=5), st.text("abc.", max_size=8))
def test_required_literals_never_exclude_a_match(atoms, value):
    pattern = "".join(atoms)
    known = regex.required_literals(pattern)
    if known is None:
        return
    found = re.search(pattern.replace("$", r"\Z"), value) is not None
    holds = any(part in value for part in known[0])
    assert holds or not found
    if known[1]:
        assert found == holds


@pytest.mark.parametrize("pattern, expected", [
    ("(?i:licen[sc]e)", ["licen"]), ("(?i)DROP\\s+Table", ["table"]), ("(?i:union.*select)", ["elect"]),
    ("(?i:a|b)", ["a", "b"]), ("(?i:a)|(?i:b)", None), ("(?i:s)", None), ("(?i:a)b", None), ("abc", None),
    ("(?i:(?:https?|file)://(?:x|y))", ["://"]), ("(?i:[)]x)", ["x"]), ("(?i:a[)]b)c", None),
])
def test_caseless_literals(pattern, expected):
    assert regex.caseless_literals(pattern) == expected


_CASELESS = st.lists(st.sampled_from(["a", "B", "s", "k", "ab", "[ab]", ".", "a?", "(?:a|b)", "|", "K"]), min_size=1, max_size=4)


@settings(max_examples=300, deadline=None)
@given(_CASELESS, st.text("abABsS\u017fkK\u212a", max_size=6), st.booleans())
def test_caseless_literals_never_exclude_a_match(atoms, value, grouped):
    inside = "".join(atoms)
    known = regex.caseless_literals(f"(?i:{inside})" if grouped else f"(?i){inside}")
    if known and re.search(inside, value, re.IGNORECASE):
        assert any(part in value.lower() for part in known)


def test_subsequence(spark):
    for needle, value, found in [("gts", "GET /TeSt", True), ("tsg", "GET /test", False), ("a.b", "xA..b", True), ("[+]", "[+] GET", True)]:
        assert one(spark, regex.subsequence(F.col("v"), needle), v=value) is found


@pytest.mark.parametrize("raw, shown", [
    ("/a b?x=1 2", "/a%20b?x=1 2"),
    ("http://h/<s>?q=<x>", "http://h/%3Cs%3E?q=<x>"),
    ("/ok'(x)!*", "/ok'(x)!*"),
    ("/a%2Fb c", "/a/b%20c"),
    ("/é", "/%C3%A9"),
    ("/a+b c~*!", "/a+b%20c~%2A%21"),
    ("/%zz", "/%zz"),
    ("http://example.com/user?id=1' OR '1'='1", "http://example.com/user?id=1' OR '1'='1"),
])
def test_canonical_url(spark, raw, shown):
    assert one(spark, urls.canonical_url(F.col("v")), v=raw) == shown


@pytest.mark.parametrize("raw, problem", [
    ("/a?b=%zz", None), ("/%zz", "bad escape in path"), ("/a\x01", "control character in url"),
    ("/a?b=\x7f", "control character in url"), (":x", "missing scheme"), ("", None),
])
def test_url_problem(spark, raw, problem):
    assert one(spark, urls.url_problem(F.col("v")), v=raw) == problem


def test_url_parts(spark):
    u = F.col("v")
    parts = F.concat_ws(" | ", urls.url_host(u), urls.url_path(u), urls.url_query(u), urls.url_target(u))
    assert one(spark, parts, v="http://me@h:80/p/q?a=<1>&b=2?#f") == "h:80 | /p/q | a=<1>&b=2? | /p/q?a=<1>&b=2?"
    assert one(spark, parts, v="/p?x=http://other/y") == " | /p | x=http://other/y | /p?x=http://other/y"


def test_arguments_may_repeat_and_be_broken(spark):
    got = one(spark, urls.parse_pairs(F.col("v")), v="a=1&a=%zz&&b=x+y%2B&c&d==&=e")
    assert [tuple(r) for r in got] == [("a", "1"), ("a", "%zz"), ("b", "x y+"), ("c", ""), ("d", "="), ("", "e")]


@pytest.mark.parametrize("raw, strict, loose", [
    ('{"a":"b","x-forwarded-for":"1, 2"}', {"A": "b", "X-Forwarded-For": "1, 2"}, None),
    ('{"k": 69}', {}, {"K": "69"}),
    ("{}", {}, None), ("", {}, None), ("nonsense", {}, None), (None, {}, None),
    ('{"a":null}', {"A": ""}, None),
    ("{'a':'b'}", {}, None),
    ('{"host":"1","Host":"2"}', {"Host": "2"}, None),
    ('{"a":"b"} x', {}, {"A": "b"}),
    ('{"a":"q\\"z"}', {"A": 'q"z'}, None),
    ('{"not a token":"1"}', {"not a token": "1"}, None),
])
def test_parse_headers(spark, raw, strict, loose):
    assert one(spark, headers.parse_headers(F.col("v")), v=raw) == strict
    assert one(spark, headers.parse_headers(F.col("v"), strict=False), v=raw) == (strict if loose is None else loose)


def test_client_ip(spark):
    h = F.from_json("h", "map<string,string>")
    got = headers.client_ip(h, F.col("remote"))
    assert one(spark, got, h='{"X-Forwarded-For":" 1.1.1.1 , 2.2.2.2"}', remote="9") == " 1.1.1.1 "
    assert one(spark, got, h="{}", remote="9.9.9.9:1") == "9.9.9.9:1"
    assert one(spark, got, h='{"X-Forwarded-For":""}', remote=None) == ""


def test_repeated_headers_are_joined(spark):
    entries = F.expr("array(named_struct('name', 'a-b', 'value', '1'), named_struct('name', 'c', 'value', '2'), named_struct('name', 'A-B', 'value', '3'))")
    assert one(spark, headers.join_header_values(entries), v="") == {"A-B": "1, 3", "C": "2"}


def test_text_helpers(spark):
    v = F.col("v")
    assert one(spark, text.ellipsize(v, 5), v="abcdef") == "abcd…"
    assert one(spark, text.ellipsize(v, 5), v="abcde") == "abcde"
    assert one(spark, text.ellipsize(v, 5, "detail"), v="éééééé") == "ééééé..."
    assert one(spark, text.placeholder(v, "-"), v="") == "-"
    assert one(spark, text.placeholder(v, "-"), v=None) == "-"
    assert one(spark, text.body_size(v), v="é") == 2
    assert one(spark, text.body_text(F.unbase64(v)), v="YWJj") == "abc"
    assert [one(spark, text.severity_name(v), v=i) for i in (-1, 0, 7, 8)] == ["UNKNOWN", "EMERGENCY", "DEBUG", "UNKNOWN"]


def test_request_key_does_not_lose_empty_parts(spark):
    keys = [one(spark, identity.request_key(F.col("a"), F.col("b"), F.col("c")), a=a, b=b, c=c)
            for a, b, c in [("GET", "/x", None), ("GET", "/x", ""), ("GET", "", "/x")]]
    assert keys[0] == keys[1] != keys[2]


def test_run_names(spark):
    v = F.col("v")
    assert tuple(one(spark, identity.parse_run_name(v), v="cb4004b7dd82-a1b2c3d4e5f6.json")) == ("cb4004b7dd82", "a1b2c3d4e5f6")
    assert one(spark, identity.parse_run_name(v), v="2026-03-11T17-11-18.json") is None
    assert one(spark, identity.run_name(F.lit("a"), F.lit("b")), v="") == "a-b"


def test_source_identity(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("GET /test HTTP/1.1\r\nHost: example.com\r\n\r\n")
    b.write_text("GET /test HTTP/1.1\r\nHost: example.org\r\n\r\n")
    one_file = identity.files_hash(spark, str(a))
    assert len(one_file) == 12 and one_file == identity.files_hash(spark, str(a)) != identity.files_hash(spark, str(b))
    both = identity.files_hash(spark, str(tmp_path))
    assert len({both, one_file, identity.files_hash(spark, str(b))}) == 3
    lines = [f"line {i}" for i in range(500)]
    before, found = spark.conf.get("spark.sql.files.maxPartitionBytes"), {}
    try:
        for size in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for change in ("none", "exchanged", "split"):
                place = tmp_path / f"{size}-{change}"
                place.mkdir()
                now = [*lines]
                if change == "exchanged":
                    now[10], now[400] = now[400], now[10]
                cut = 250 if change == "split" else 500
                (place / "z").write_text("\n".join(now[:cut]) + "\n")
                (place / "y").write_text("\n".join(now[cut:]))
                found[size, change] = identity.files_hash(spark, str(place))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(set(found.values())) == 3 and all(found["128m", c] == found["1k", c] for c in ("none", "exchanged", "split"))
    with pytest.raises(Exception):
        identity.files_hash(spark, str(tmp_path / "missing"))
    assert identity.traffic_hash_of_sql("SELECT 1") != identity.traffic_hash_of_sql("SELECT 2")


@pytest.mark.parametrize("value, seconds", [("24h", 86400), ("1h30m", 5400), ("0", 0), ("90s", 90), ("", 86400), (None, 86400), ("soon", 86400), ("2d", 86400)])
def test_durations(value, seconds):
    assert identity.duration_seconds(value) == seconds


_PIECES = [
    "a", "b", ".", "[ab]", "[^a]", r"\s", r"\S", r"\d", r"\w", r"\W", r"\b", "^", "$", "(?i:A)", "(?:ab|c)", "a*", "b+?", "c{1,2}",
    "[[:alpha:]]", "[^[:space:]]", r"\.", r"\$", "{", "[&&a]", "[]b]", "[[]", "(?s:.)", "(?m:^b)", "(?m:a$)", "|", r"\x41", "(?P<n>b)",
    r"[\s\d]", r"\v", r"\pL", "(?i:s)", "(?U:a+)", "(?m)", "(?-m:^a)", "(a$|b)",
]
_VALUES = ["", "a", "b\n", "ab c", "A\tb", "1.2", "a\x0bb", "x\r\ny", "$[a]", "{b}", "&&", "_b_", "éa", "ſ", "cc\nb", "AaBb", "]", "\x41b"]


def test_patterns_agree_with_another_re2(spark):
    """Random patterns over all values: Spark with translated patterns and DuckDB's RE2."""
    import random

    import duckdb

    rng, patterns = random.Random(11), set()
    while len(patterns) < 400:
        patterns.add("".join(rng.choice(_PIECES) for _ in range(rng.randrange(1, 5))))
    con, usable, expected = duckdb.connect(), [], {}
    for pattern in sorted(patterns):
        try:
            rows = con.execute("select list(regexp_matches(v, ?) order by i) from (select unnest(?) as v, unnest(range(?)) as i)",
                               [pattern, _VALUES, len(_VALUES)]).fetchall()
        except duckdb.Error:
            continue
        usable.append(pattern)
        expected[pattern] = rows[0][0]
    assert len(usable) > 300
    df = spark.createDataFrame(list(enumerate(_VALUES)), "i int, v string").orderBy("i")
    rows = df.select(*[regex.matches(F.col("v"), p).alias(str(n)) for n, p in enumerate(usable)]).collect()
    wrong = {p: [v for v, r, e in zip(_VALUES, rows, expected[p]) if r[n] != e] for n, p in enumerate(usable)}
    assert {p: v for p, v in wrong.items() if v} == {}
