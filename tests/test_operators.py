from __future__ import annotations

import itertools
import os
import random
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reqsieve.functions.identity import sql_hash
from reqsieve.operators import catalog, compare, reports, store
from reqsieve.operators.matching import analyze
from reqsieve.schemas import VERDICT
from reqsieve.session import create_new, remove
from reqsieve.sources.rules import Rule
from reqsieve.sources.reports import scan_results
from reqsieve.plans import tables as T


def verdicts(spark, *rows):
    """(req_id, seq, url, [rule ids]) as blocked verdicts."""
    return spark.createDataFrame([
        (i, seq, "GET", url, url, "", "", "", {"User-Agent": f"ua-{i}"}, "", f"ip-{i}", "", True,
         [(r, f"Rule {r}", "HIGH", [f"tag{r}"]) for r in rules], ("deny", 403), "")
        for i, seq, url, rules in rows
    ], VERDICT)


# Comparing runs.


@pytest.mark.parametrize("one, two, summary", [
    ([("a", 1, "/test1", ["1"])], [("a", 1, "/test1", ["1"]), ("b", 2, "/test2", ["1"])], (1, 1, 0, 0)),
    ([("a", 1, "/test1", ["1"]), ("b", 2, "/test2", ["1"])], [("a", 1, "/test1", ["1"])], (1, 0, 1, 0)),
    ([("a", 1, "/test1", ["1"])], [("a", 1, "/test1", ["1", "2"])], (1, 0, 0, 1)),
    ([("a", 1, "/test1", ["1"])], [("x", 9, "/test1", ["1"])], (0, 0, 0, 0)),
    ([], [], (0, 0, 0, 0)),
])
def test_diff(spark, one, two, summary):
    v1, v2 = verdicts(spark, *one), verdicts(spark, *two)
    diff = compare.diff_runs(v1, v2)
    assert tuple(compare.diff_summary(diff).first()) == summary
    assert compare.added(v1, v2).count() == summary[1] and compare.removed(v1, v2).count() == summary[2]
    assert compare.diff_details(diff, v1, v2).count() == summary[0]


def test_diff_views(spark):
    v1 = verdicts(spark, ("a", 1, "/gone", ["1"]), ("b", 2, "/changed", ["1"]))
    v2 = verdicts(spark, ("c", 3, "/changed", ["2"]), ("d", 4, "/new", []))
    diff = compare.diff_runs(v1, v2)
    assert {r.title: r.meaning for r in compare.diff_titles(diff).collect()} == {
        "[-] GET /gone": "No longer blocked", "[~] GET /changed": "Rules changed", "[+] GET /new": "New blocked request"}
    assert {r.key: r.n for r in compare.diff_group_by_type(diff).collect()} == {"Added": 1, "Removed": 1, "Modified": 1}
    assert {r.key: r.n for r in compare.diff_group_by_rule(diff).collect()} == {"Rule 1: Rule 1": 2, "No rules": 1}
    sides = {r.url: (r.result1 and r.result1.client_ip, r.result2 and r.result2.client_ip)
             for r in compare.diff_details(diff, v1, v2).collect()}
    assert sides == {"/gone": ("ip-a", None), "/changed": ("ip-b", "ip-c"), "/new": (None, "ip-d")}
    found = reports.search(compare.diff_titles(diff), "[~]cgd", F.col("title"))
    assert [r.title for r in found.collect()] == ["[~] GET /changed"]


def test_rules_equal_is_one_sided(spark):
    def equal(a, b):
        row = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
        return row.select(compare.rules_equal(F.col("a"), F.col("b"))).first()[0]

    assert equal(["1", "2"], ["2", "1"]) and equal([], []) and equal(["1", "2"], ["1", "1"])
    assert not equal(["1", "1"], ["1", "2"]) and not equal(["1"], ["1", "2"])


def test_the_last_of_equal_requests_wins_also_for_a_hot_key(spark):
    rows = [(f"i{n:04}", n, "/hot" if n % 3 else f"/cold{n}", [str(n)]) for n in range(900)]
    random.Random(5).shuffle(rows)
    v = verdicts(spark, *rows).repartition(7)
    kept = {r.url: r.req_seq for r in compare.dedupe_by_key(v).collect()}
    assert len(kept) == 301 and kept["/hot"] == 899
    diff = compare.diff_runs(v, verdicts(spark, ("z", 1, "/hot", ["899"])))
    assert tuple(compare.diff_summary(diff).first()) == (300, 0, 300, 0)


# Reports.


def test_groups(spark):
    v = verdicts(spark, *[(f"i{n}", n, f"/{n}", ["1" if n < 7 else "2"] if n else []) for n in range(9)])
    assert [(r.key, r.n) for r in reports.group_by_rule(v).collect()] == [("Rule 1: Rule 1", 6), ("Rule 2: Rule 2", 2), ("No rules", 1)]
    assert reports.group_by_ip(v.withColumn("client_ip", F.lit(""))).first().key == "Unknown IP"
    agents = v.withColumn("headers", F.create_map(F.lit("User-Agent"), F.repeat(F.lit("x"), 51)))
    assert reports.group_by_user_agent(agents).first().key == "x" * 50 + "..."
    assert reports.group_by_user_agent(v.withColumn("headers", F.map_filter("headers", lambda k, v: F.lit(False)))).first().key == "No User-Agent"
    row = reports.verdict_examples(v).where("key like 'Rule 1%'").first()
    assert (row.n, row.more, row.examples) == (6, 1, [f"GET /{n} [ip-i{n}]" for n in range(1, 6)])


def test_examples_of_a_hot_group_are_cut_before_the_shuffle(spark):
    v = verdicts(spark, ("a", 1, "/a", ["1"]))
    plan = reports.verdict_examples(v)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("WindowGroupLimit [key", plan.index("Final")) and "row_number(), 5, Partial" in plan


def test_blocked_share(spark):
    df = spark.createDataFrame([(1, 4), (0, 0)], "b long, t long")
    assert [r[0] for r in df.select(reports.blocked_pct(F.col("b"), F.col("t"))).collect()] == [25.0, 0.0]


def _best(value, text):
    """The best score over all ways to find the text, tried one by one."""
    value, text = value.lower(), text.lower()
    scores = []
    for places in itertools.combinations(range(len(value)), len(text)):
        if [value[p] for p in places] == list(text):
            starts = sum(p == 0 or not value[p - 1].isalnum() for p in places)
            runs = sum(b == a + 1 for a, b in zip(places, places[1:]))
            scores.append(reports.HIT * len(text) + reports.START * starts + reports.RUN * runs)
    return max(scores, default=None)


def test_match_score(spark):
    draw = random.Random(5)
    values = ["".join(draw.choice("aAb/1é ") for _ in range(draw.randint(0, 11))) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    for text in ("a", "ab", "aab", "A/b", "1éa"):
        rows = df.select("v", reports.match_score(F.col("v"), text).alias("s")).collect()
        assert [r.s for r in rows] == [None if r.v is None else _best(r.v, text) for r in rows]
    assert {r.s for r in df.select(reports.match_score(F.col("v"), "").alias("s")).collect()} == {0, None}


def test_search_ranked(spark):
    v = verdicts(spark, ("a", 1, "/xsearchx", ["7"]), ("b", 2, "/search", ["7"]), ("c", 3, "/s/e/arch", ["7"]), ("d", 4, "/search", ["7"]),
                 ("e", 5, "/other", ["8"]))
    found = reports.search_ranked(v, "SEARCH", 10)
    assert [(r.req_id, r.score) for r in found.collect()] == [("b", 40), ("d", 40), ("a", 36), ("c", 36)]
    assert all(r.score == _best(f"GET {r.url} tag7", "search") for r in found.collect())
    assert [r.req_id for r in reports.search_ranked(v, "search", 1).collect()] == ["b"]
    assert {r.req_id for r in found.collect()} == {r.req_id for r in reports.search(v, "SEARCH").collect()}
    assert [(r.req_id, r.score) for r in reports.search_ranked(v, "", 2).collect()] == [("a", 0), ("b", 0)]
    assert "TakeOrderedAndProject" in found._jdf.queryExecution().executedPlan().toString()
    assert reports.search_ranked(v.limit(0), "x", 5).count() == 0


def test_search(spark):
    v = verdicts(spark, ("a", 1, "/Search?q=1", ["7"]), ("b", 2, "/other", ["8"]))
    assert [r.req_id for r in reports.search(v, "gsrch").collect()] == ["a"]
    assert [r.req_id for r in reports.search(v, "TAG8").collect()] == ["b"]
    assert reports.search(v, "").count() == 2 and reports.search(v, "a.c").count() == 0


@pytest.mark.parametrize("parts", [None, 1, 7, 64])
def test_numbers_are_exact_however_the_order_is_cut(spark, parts):
    df = spark.range(20000).select((F.col("id") * 7919 % 20011).alias("k"), F.md5(F.col("id").cast("string")).alias("s"))
    want = {k: i + 1 for i, k in enumerate(sorted(r.k for r in df.collect()))}
    assert {r.k: r.n for r in reports.numbered(df, "k", parts=parts).collect()} == want
    text = {r.s: r.n for r in reports.numbered(df, "s", "k", parts=parts).collect()}
    assert [s for s, _ in sorted(text.items(), key=lambda e: e[1])] == sorted(text)


def test_numbers_of_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(None,), (3,), (1,), (3,), (3,), (None,)], "k int")
    assert sorted((r.n, r.k) for r in reports.numbered(df, "k").collect() if r.k) == [(3, 1), (4, 3), (5, 3), (6, 3)]
    assert sorted(r.n for r in reports.numbered(df, "k").collect()) == [1, 2, 3, 4, 5, 6]
    assert reports.numbered(df.limit(0), "k").columns == ["k", "n"] and reports.numbered(df.limit(0), "k").count() == 0


def test_a_listing_moves_no_bodies_and_has_no_window(spark):
    rows = reports.list_requests(verdicts(spark, *[(f"r{i}", i, f"/{i}", []) for i in range(300)]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "body" not in plan
    assert [r.path for r in rows.orderBy("n").collect()] == [f"/{i}" for i in range(300)]


def test_listing(spark):
    v = verdicts(spark, ("a", 2, "/b%20c/" + "x" * 60, []), ("b", 1, "/a", []))
    rows = reports.list_requests(v).orderBy("n").collect()
    assert [(r.n, r.path, r.host) for r in rows] == [(1, "/a", "-"), (2, "/b c/" + "x" * 44 + "…", "-")]
    full = reports.list_requests(v, more=True).orderBy("n").first()
    assert full.headers == ["User-Agent: ua-b"] and full.body_bytes == 0
    assert reports.limit(v, 1, "req_seq").first().req_id == "b" and reports.limit(v, 0, "req_seq").count() == 2


# Run catalogue.


def test_catalogue_against_brute_force(spark):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(f"r{i}", "hot" if rng.random() < .4 else f"t{rng.randrange(6)}", f"x{rng.randrange(3)}", start + timedelta(minutes=rng.randrange(200)), i)
            for i in range(300)] + [("single", "alone", "x0", start, 300)]
    runs = spark.createDataFrame(rows, "run_id string, traffic_hash string, rules_hash string, finished_at timestamp, seq long")
    order = lambda r: (r[3], r[4])
    latest = {t: max((r for r in rows if r[1] == t), key=order)[0] for t in {r[1] for r in rows}}
    assert {r.traffic_hash: r.run_id for r in catalog.latest_run(runs, "finished_at", "seq").collect()} == latest
    previous = {}
    for r in rows:
        others = [o for o in rows if o[1] == r[1] and o[2] != r[2]]
        previous[r[0]] = max(others, key=order)[0] if others else None
    got = catalog.previous_run_other_rules(runs, "finished_at", "seq").collect()
    assert {r.run_id: r.previous_run_id for r in got} == previous and previous["single"] is None
    counts = {r.traffic_hash: r.runs for r in catalog.runs_per_traffic(runs).collect()}
    assert sum(counts.values()) == 301


def test_baseline_state_against_replay(spark):
    rng = random.Random(9)
    log = [("d%d" % rng.randrange(4), "n%d" % rng.randrange(3), i) for i in range(120)] + [("one", "only", 999)]
    state = {}
    for directory, name, _ in log:
        current, previous = state.get(directory, (None, None))
        if name != current:
            state[directory] = (name, current if current is not None else previous)
    df = spark.createDataFrame(log, "directory string, name string, at long")
    found = catalog.baseline_state(df)
    assert {r.directory: (r.current, r.previous) for r in found.collect()} == state
    with pytest.raises(ValueError):
        catalog.swapped_baseline(found, "one")


def test_freshness(spark):
    now = datetime(2024, 1, 2, 0, 0, 0)
    runs = spark.createDataFrame([("a", now - timedelta(hours=1)), ("b", now - timedelta(hours=1, microseconds=1))], "run_id string, finished_at timestamp")
    at = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert [(r.age_seconds, r.fresh) for r in catalog.freshness(runs, at, 3600).orderBy("run_id").collect()] == [(3600, True), (3600, False)]
    assert all(r.fresh for r in catalog.freshness(runs, at, 0).collect())


# Store.

RULES = [Rule(1, "1", "ones", "1", location="url", action="block", severity="LOW")]
OTHER = [Rule(1, "2", "twos", "2", location="url", action="block", severity="LOW")]


def _traffic(spark):
    from reqsieve.sources.requests import map_columns

    rows = spark.range(40).selectExpr("'GET' as m", "concat('/', id) as p", "id")
    return map_columns(rows, {"method": "m", "path": "p", "id": "id", "seq": "id"})


def test_runs_are_stored(spark, folder):
    done = store.write_run(analyze(_traffic(spark), RULES), "1234e5678901", "000000000001", folder)
    assert (done["total_requests"], done["blocked_requests"]) == (40, 13)
    row = store.read_verdicts(spark, folder, done["run_id"]).orderBy("req_seq").first()
    assert (row.url, row.traffic_hash, row.rules_hash, row.run_id) == ("/1", "1234e5678901", "000000000001", done["run_id"])
    assert store.read_verdicts(spark, folder).count() == 13
    assert store.read_runs(spark, folder).first().asDict()["total_requests"] == 40
    files = store.read_verdicts(spark, folder, done["run_id"]).inputFiles()
    assert files and all(f"run_id={done['run_id']}" in f for f in files)
    assert store.read_verdicts(spark, folder, "none").count() == 0


def test_export_comes_back(spark, folder):
    v = analyze(_traffic(spark), RULES)
    store.export_results(v, folder)
    back = scan_results(spark, folder)
    pick = ["req_id", "method", "url", "client_ip", "blocked", "rules_triggered", "interruption", "logs"]
    assert sorted(map(str, back.select(pick).collect())) == sorted(map(str, v.where("blocked").select(pick).collect()))


def test_a_run_is_exported(spark, folder):
    done = store.write_run(analyze(_traffic(spark), RULES), "t", "r", folder)
    store.export_run(spark, folder, done["run_id"], f"{folder}/export")
    assert scan_results(spark, f"{folder}/export/results").count() == 13
    row = spark.read.json(f"{folder}/export/metadata").first()
    assert (row.total_requests, row.blocked_requests, row.traffic_hash, row.rules_hash) == (40, 13, "t", "r")


def test_fresh_runs_are_reused(spark, folder):
    calls = []

    def traffic():
        calls.append(1)
        return _traffic(spark)

    first = store.analyze_or_reuse(spark, folder, "t", traffic, RULES)
    assert store.analyze_or_reuse(spark, folder, "t", traffic, RULES) == first and len(calls) == 1
    assert store.analyze_or_reuse(spark, folder, "t", traffic, OTHER) != first
    assert store.analyze_or_reuse(spark, folder, "u", traffic, RULES) != first
    assert store.analyze_or_reuse(spark, folder, "t", traffic, RULES, ttl_seconds=0) == first
    _age(spark, folder, "runs", "finished_at")
    again = store.analyze_or_reuse(spark, folder, "t", traffic, RULES, ttl_seconds=3600)
    assert again != first and len(calls) == 4
    assert store.analyze_or_reuse(spark, folder, "t", traffic, RULES, ttl_seconds=3600) == again


def _age(spark, folder, log, column):
    """Make all rows of a log two hours older."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/{log}")
    older = rows.withColumn(column, F.col(column) - F.expr("interval 2 hours")).collect()
    spark.createDataFrame(older, rows.schema).write.mode("overwrite").parquet(f"{folder}/{log}")


def test_query_results_are_reused(spark, folder):
    spark.range(5).createOrReplaceTempView("numbers")
    sql = "select id from numbers"
    assert store.lookup(spark, sql, folder) is None
    assert store.materialize(spark, sql, folder).count() == 5
    spark.range(7).createOrReplaceTempView("numbers")
    assert store.materialize(spark, sql, folder).count() == 5
    assert store.materialize(spark, sql + " ", folder).count() == 7
    _age(spark, folder, "query_results", "stored_at")
    assert store.lookup(spark, sql, folder) and store.lookup(spark, sql, folder, 0) and store.lookup(spark, sql, folder, 3 * 3600)
    assert store.lookup(spark, sql, folder, 3600) is None
    first = store.lookup(spark, sql, folder)
    read = spark.read.parquet(first)
    assert store.materialize(spark, sql, folder, 3600).count() == 7
    assert read.count() == 5 and store.lookup(spark, sql, folder) != first  # the stale one can still be read
    assert store.remove_replaced(spark, folder, sql_hash(sql)) == []
    time.sleep(1.1)
    assert store.remove_replaced(spark, folder, sql_hash(sql), grace_seconds=1) == [first] and not os.path.exists(first)
    entries = store.read_query_results(spark, folder)
    assert {r.key for r in entries.collect()} == {sql_hash(sql), sql_hash(sql + " ")}
    stats = catalog.store_stats(entries).first()
    assert stats.entries == 2 and stats.total_mb > 0 and len(catalog.store_list(entries).first().key) == 12


def test_two_refreshes_and_lost_places(spark, folder):
    spark.range(3).createOrReplaceTempView("numbers")
    sql = "select id from numbers"
    with ThreadPoolExecutor(2) as pool:
        both = list(pool.map(lambda _: store.materialize(spark, sql, folder).count(), range(2)))
    assert both == [3, 3] and store.read_query_results(spark, folder).count() == 1
    place = store.lookup(spark, sql, folder)
    assert spark.read.parquet(place).count() == 3
    remove(spark, place)
    assert store.lookup(spark, sql, folder) is None and store.materialize(spark, sql, folder).count() == 3
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        store.materialize(spark, "select 1 / (id - id) as x from numbers", folder)


def test_a_file_is_made_once(spark, folder):
    assert create_new(spark, f"{folder}/x", "one") and not create_new(spark, f"{folder}/x", "two")
    assert open(f"{folder}/x").read() == "one"


def test_a_result_that_cannot_be_stored_is_still_given(spark):
    assert store.materialize(spark, "select 1 as one", "/proc/no/such/place").first().one == 1


def test_baseline_workflow(spark, folder):
    first = store.write_run(analyze(_traffic(spark), RULES), "t", "r1", folder)["run_id"]
    with pytest.raises(ValueError):
        store.diff_against_baseline(spark, folder, "t")
    store.set_baseline(spark, folder, first)
    with pytest.raises(ValueError):
        store.swap_baseline(spark, folder)
    second = store.write_run(analyze(_traffic(spark), OTHER), "t", "r2", folder)["run_id"]
    summary = compare.diff_summary(store.diff_against_baseline(spark, folder, "t")).first()
    assert tuple(summary) == (24, 11, 11, 2)
    store.set_baseline(spark, folder, second)
    assert compare.diff_summary(store.diff_against_baseline(spark, folder, "t")).first().total == 0
    store.swap_baseline(spark, folder)
    state = store.read_baseline(spark, folder).first()
    assert (state.current, state.previous) == (first, second)
    now = store.status(spark, folder, "t")
    assert now.pop("age_seconds") >= 0
    assert now == {"runs": 2, "latest": second, "baseline": first, "previous_baseline": second, "entries": 0, "total_mb": 0.0}
    assert store.status(spark, folder, "unknown")["latest"] is None
    with pytest.raises(ValueError):
        store.diff_against_baseline(spark, folder, "unknown")


def test_stored_runs_meet_without_a_shuffle(spark, sf_dir, folder):
    requests = T.requests(spark, sf_dir)
    for i, rules in enumerate((T.RULES_V1, T.RULES_V2)):
        store.write_run(analyze(requests, rules), "t", f"r{i}", folder, f"run{i}")
    plain = compare.diff_runs(store.read_verdicts(spark, folder, "run0"), store.read_verdicts(spark, folder, "run1"))
    want = sorted(map(str, plain.collect()))
    d = store.diff_stored(spark, folder, "run0", "run1", bucket_keys=40)
    assert sorted(map(str, d.collect())) == want and want
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    def kept():
        return sorted(os.path.join(at, f) for at, _, files in os.walk(f"{folder}/keys") for f in files)
    files = kept()
    for row in spark.sql("show tables like 'reqsieve_keys_*'").collect():  # another session knows no tables
        spark.sql(f"drop table {row.tableName}")
    assert kept() == files
    os.makedirs(f"{folder}/keys/run_id=run0/{os.listdir(f'{folder}/keys/run_id=run0')[0]}/0-not-complete")
    assert sorted(map(str, store.diff_stored(spark, folder, "run0", "run1", bucket_keys=40).collect())) == want
    assert kept() == files  # read, not written again
    back = store.diff_stored(spark, folder, "run1", "run0", bucket_keys=1 << 20)  # other buckets
    assert compare.diff_summary(back).first().asDict() == {
        k: v for k, v in zip(("total", "removed", "added", "modified"), compare.diff_summary(plain).select("total", "added", "removed", "modified").first())}
    store.write_run(analyze(requests.limit(0), T.RULES_V1), "t", "r2", folder, "none")
    assert compare.diff_summary(store.diff_stored(spark, folder, "none", "none")).first().total == 0
    gone = compare.diff_summary(store.diff_stored(spark, folder, "run0", "none")).first()
    assert gone.total == gone.removed > 0


def test_verdict_rows_carry_no_order_dependence(spark, sf_dir):
    a = analyze(T.requests(spark, sf_dir), T.RULES_V1).select("req_id", "logs").collect()
    b = analyze(T.requests(spark, sf_dir).repartition(13), T.RULES_V1).select("req_id", "logs").collect()
    assert sorted(a) == sorted(b)


def test_scratch_folders_are_shared(spark):
    from reqsieve.session import shared_dir

    one, two = shared_dir(spark), shared_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir")
    assert one != two and one.startswith(base) and two.startswith(base)


def test_baseline_without_a_name_and_of_no_run(spark, folder):
    with pytest.raises(ValueError, match="no analysis results"):
        store.set_baseline(spark, folder)
    run = store.write_run(analyze(_traffic(spark), RULES), "t", "r1", folder)["run_id"]
    with pytest.raises(ValueError, match="no run"):
        store.set_baseline(spark, folder, "none")
    store.set_baseline(spark, folder, traffic_hash="t")
    assert store.read_baseline(spark, folder).first().current == run


def test_results_without_a_number_are_compared(spark):
    v = analyze(_traffic(spark), RULES).where("blocked").withColumn("req_seq", F.lit(None).cast("long"))
    other = v.withColumn("rules_triggered", F.array_repeat(F.get("rules_triggered", 0), 2))
    rows = compare.diff_details(compare.diff_runs(v, other), v, other).collect()
    assert rows and all(r.result1 is not None and r.result2 is not None for r in rows)
    assert compare.dedupe_by_key(v).count() == v.select("method", "url", "body").distinct().count()


def test_few_changes_move_no_bodies(spark):
    v = analyze(_traffic(spark), RULES).where("blocked")
    missing = compare.added(v.limit(5), v)
    plan = missing._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r.req_key for r in missing.collect()} == (
        {r.req_key for r in compare.with_key(v).collect()} - {r.req_key for r in compare.with_key(v.limit(5)).collect()})
    details = compare.diff_details(compare.diff_runs(v.limit(5), v), v.limit(5), v)
    assert "SortMergeJoin" not in details._jdf.queryExecution().executedPlan().toString()
