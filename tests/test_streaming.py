from __future__ import annotations

import os

import pytest
from fixtures import CAPTURE_1, CAPTURE_2, NDJSON, PATTERN_RULES, write_capture, write_ndjson

from reqsieve.operators import reports
from reqsieve.operators.matching import analyze
from reqsieve.sources.capture import scan_capture
from reqsieve.sources.ndjson import scan_ndjson
from reqsieve.sources.rules import Rule
from reqsieve.streaming import analyze as stream
from reqsieve.streaming import rules

RULES = [Rule(i, r["id"], r["name"], r["pattern"], location=r["location"], action=r["action"], severity=r["severity"])
         for i, r in enumerate(PATTERN_RULES["rules"])]
COLUMNS = ["method", "url", "body", "client_ip", "rules_triggered.id", "logs"]


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()

    def advance():
        requests = stream.stream_ndjson(spark, str(source), files_per_trigger=1)
        stream.stream_analyze(requests, RULES, out, mark).awaitTermination()
        totals = stream.stream_totals(requests, RULES, f"{out}-totals", f"{mark}-totals")
        totals.awaitTermination()
        batch = analyze(scan_ndjson(spark, str(source)), RULES)
        key = str
        assert sorted(spark.read.parquet(out).select(*COLUMNS).collect(), key=key) == sorted(batch.where("blocked").select(*COLUMNS).collect(), key=key)
        assert stream.read_stream_totals(spark, f"{out}-totals").first() == reports.totals(batch).first()

    write_ndjson(source / "a.json", extra=["{broken"])
    write_ndjson(source / "b.json", NDJSON[1:3])
    advance()
    write_ndjson(source / "c.json", NDJSON[2:])
    advance()


def test_captures_as_a_stream(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    for name, lines in (("a", CAPTURE_1), ("b", CAPTURE_2), ("c", [*CAPTURE_1, "broken"])):
        write_capture(source / f"{name}.gor", lines)
        requests = stream.stream_capture(spark, str(source), files_per_trigger=1)
        assert requests.isStreaming
        stream.stream_analyze(requests, RULES, out, mark).awaitTermination()
        batch = analyze(scan_capture(spark, str(source)), RULES).where("blocked")
        columns = ["req_id", "req_seq", *COLUMNS]
        want = sorted(batch.select(*columns).collect(), key=str)
        assert sorted(spark.read.parquet(out).select(*columns).collect(), key=str) == want and want


def test_observed_totals_go_on_without_state(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), tmp_path / "mark"
    source.mkdir()
    for name, rows in (("a", NDJSON), ("b", NDJSON[1:3]), ("c", NDJSON[2:])):
        write_ndjson(source / f"{name}.json", rows)
        requests = stream.stream_ndjson(spark, str(source), files_per_trigger=1)
        stream.stream_observed_totals(requests, RULES, out, str(mark)).awaitTermination()
        batch = analyze(scan_ndjson(spark, str(source)), RULES)
        assert stream.read_observed_totals(spark, out).first() == reports.totals(batch).first()
        assert spark.read.parquet(f"{out}/verdicts").count() == batch.where("blocked").count()
    assert not (mark / "state").exists()


def _rerun_last(mark):
    """As after a failure: the last batch was begun but not committed."""
    last = max(int(n) for n in os.listdir(mark / "commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if (mark / "commits" / name).exists():
            (mark / "commits" / name).unlink()


def test_rules_change_between_batches(spark, tmp_path):
    source, out, mark, root = tmp_path / "in", str(tmp_path / "out"), tmp_path / "mark", str(tmp_path / "rules")
    source.mkdir()

    def advance():
        requests = stream.stream_ndjson(spark, str(source), files_per_trigger=1)
        rules.stream_with_rules(requests, root, out, str(mark)).awaitTermination()
        return sorted((r.url, r.rules_version, tuple(t.id for t in r.rules_triggered)) for r in spark.read.parquet(out).collect())

    write_ndjson(source / "a.json", NDJSON)
    with pytest.raises(Exception, match="no rules are published"):
        advance()
    assert rules.publish_rules(spark, RULES, root) == 1
    first = advance()
    assert first and {v for _, v, _ in first} == {1}
    fewer = [r for r in RULES if r.id == first[0][2][0]]
    assert rules.publish_rules(spark, fewer, root) == 2 and rules.published(spark, root) == [1, 2]
    _rerun_last(mark)
    assert advance() == first  # run again with the rules it had
    write_ndjson(source / "b.json", NDJSON)
    both = advance()
    assert [r for r in both if r[1] == 1] == first
    want = analyze(scan_ndjson(spark, str(source / "b.json")), fewer).where("blocked")
    assert [(u, t) for u, v, t in both if v == 2] == sorted((r.url, tuple(t.id for t in r.rules_triggered)) for r in want.collect())
    (tmp_path / "rules" / "version=3").mkdir()  # not complete
    _rerun_last(mark)
    assert advance() == both


def test_parquet_tables_that_are_folders(spark, tmp_path):
    source, columns = tmp_path / "in", {"id": "id", "method": "method", "path": "path", "body": "body"}
    rows = spark.createDataFrame([(str(i), "GET", f"/{i}", "<script") for i in range(6)], list(columns))
    rows.repartition(3).write.parquet(str(source / "t.parquet"))
    rows.withColumn("id", (rows.id.cast("long") + 100).cast("string")).write.parquet(str(source / "other.parquet"))
    rules_ = [Rule(1, "s", "s", "<script", location="body", action="block")]

    def read(number, files):
        out, mark = str(tmp_path / f"out{number}"), str(tmp_path / f"mark{number}")
        requests = stream.stream_parquet(spark, str(source), columns, files=files, files_per_trigger=2)
        stream.stream_analyze(requests, rules_, out, mark).awaitTermination()
        return sorted(float(r.req_id) for r in spark.read.parquet(out).collect())

    assert read(1, "t.parquet") == list(range(6))
    assert read(2, "*.parquet") == [*range(6), *range(100, 106)]
    rows.limit(2).write.mode("append").parquet(str(source / "t.parquet"))
    assert len(read(1, "t.parquet")) == 8
