"""ARC to WARC: round trips, versions, revisits, odd rows."""

from __future__ import annotations

import base64
import glob
import hashlib

import pytest

from reqsieve.llm import archives
from reqsieve.llm.queries import QUERIES


def expected(rows):
    """By the contract: of equal payloads the greatest number is the response."""
    best = {}
    for n, html in rows:
        key = (html or "").encode()
        best[key] = max(best.get(key, n), n)
    out = []
    for n, html in rows:
        key = (html or "").encode()
        first = n == best[key]
        out.append((n, len(key), base64.b32encode(hashlib.sha1(key).digest()).decode(),
                    "response" if first else "revisit", None if first else best[key]))
    return sorted(out)


def round_trip(spark, df, tmp_path, **options):
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    archives.write_arc(df, arc)
    archives.convert(spark, arc, warc, **options)
    return archives.page_records(spark, warc), arc, warc


def tuples(df):
    return sorted(tuple(r)[:5] for r in df.collect())


def test_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    assert tuples(QUERIES["op2_warc"](spark, sf_dir)) == expected([tuple(p) for p in pages])


def test_copies_nulls_and_breaks(spark, table, tmp_path):
    html = [None, "", "a", "a", "a\r\n\r\nWARC/1.0\r\n", "a", "b\n\n", None, "x" * 200_000, "é"]
    rows = [(i, [None, "http://a b/\n", "http://x/"][i % 3], h, "clash") for i, h in enumerate(html)]
    df = table(rows, "page_id long, url string, html string, payload_digest string").repartition(3)
    found, arc, _ = round_trip(spark, df, tmp_path)
    assert tuples(found) == expected([(r[0], r[2]) for r in rows])
    assert {r.uri for r in found.collect()} == {"urn:unknown", "http://a%20b/%0A", "http://x/"}
    versions = {archives.unpacked(open(f, "rb").read()).split(b"\n")[1][:1] for f in glob.glob(f"{arc}/part-*")}
    assert versions == {b"1", b"2"}


def test_repeated_rows_and_missing_numbers(spark, table, tmp_path):
    df = table([(7, "u", "same"), (7, "u", "same"), (None, "u", "same")], "page_id long, url string, html string").coalesce(1)
    found, *_ = round_trip(spark, df, tmp_path)
    rows = found.collect()
    assert sorted(r.record_type for r in rows) == ["response", "revisit", "revisit"]
    assert {r.refers_to for r in rows if r.record_type == "revisit"} == {7}
    assert len({r.record_id for r in rows}) == 3


def test_small_payloads_stay(spark, table, tmp_path):
    df = table([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    found, *_ = round_trip(spark, df, tmp_path, min_revisit_bytes=3)
    assert {(r.page_id, r.record_type) for r in found.collect()} == {
        (1, "response"), (2, "response"), (3, "revisit"), (4, "response")}


def test_numbers_of_any_size(spark, table, tmp_path):
    ids = [-(1 << 63), (1 << 63) - 1, 1234567890123456789, -1234567890123456789, 0, 10**18]
    df = table([(i, "u", "same") for i in ids], "page_id long, url string, html string").repartition(3)
    found, *_ = round_trip(spark, df, tmp_path)
    assert tuples(found) == expected([(i, "same") for i in ids])
    beyond = archives.Record(0, {}, b"", b"", {archives.NUMBER.lower(): str(1 << 63)})
    assert beyond.number is None


def test_damaged_warc_records_are_skipped(spark, tmp_path):
    def record(kind, block=b"HTTP/1.1 200 OK\r\nX-Record-Number: 5\r\n\r\nbody", **change):
        fields = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2000-01-01T00:00:00Z", "Content-Length": str(len(block))} | change
        return "\r\n".join(["WARC/1.0", *[f"{k}: {v}" for k, v in fields.items() if v is not None], "", ""]).encode() + block + b"\r\n\r\n"

    bad = [{"Content-Length": None}, {"Content-Length": "x"}, {"Content-Length": "-1"}, {"Content-Length": "99999999"}, {"WARC-Type": None},
           {"WARC-Record-ID": None}]
    data = b"".join([record("response", **{k.replace("_", "-"): v for k, v in c.items()}) for c in bad])
    data += record("revisit", **{"WARC-Record-ID": "<urn:uuid:2>"}) + record("response", **{"WARC-Date": None}) + b"WARC/1.0\r\nWARC-Type: x"
    (tmp_path / "warc").mkdir()
    (tmp_path / "warc" / "part-00000-x.warc").write_bytes(data)
    rows = archives.read_warc(spark, str(tmp_path / "warc")).collect()
    assert [(r.record_type, r.record_id, r.number, r.payload_bytes, r.date) for r in rows] == [
        ("revisit", "urn:uuid:2", 5, None, "2000-01-01T00:00:00Z"), ("response", "urn:uuid:1", 5, 4, None)]
    assert archives.page_records(spark, str(tmp_path / "warc")).count() == 2


def test_empty_table(spark, table, tmp_path):
    df = table([], "page_id long, url string, html string")
    found, *_ = round_trip(spark, df, tmp_path)
    assert found.count() == 0


def test_parse_by_version_and_length():
    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nline\nhttp://x/ 1.1.1.1 20010101000000 text/html 3\n"
    one = archives.version_block(1, "n", "20010203040506") + b"\n" + archives.arc_record(1, "http://a b/", "1.2.3.4", "20010203040506", "text/html", body)
    two = archives.version_block(2, "n", "20010203040506") + b"\n" + archives.arc_record(2, "dns:x", "1.2.3.4", "20010203", "text/dns", b"1.1")
    first, second = archives.parse_arc(one + b"\n" + b"junk without length\n" + two)
    assert (first.fields["URL"], first.payload, first.names) == ("http://a b/", body.partition(b"\r\n\r\n")[2], {"a": "b"})
    assert (second.fields["Result-code"], second.fields["URL"], second.payload, second.head) == ("200", "dns:x", b"1.1", b"")
    assert archives.iso_date(second.fields["Archive-date"]) == "2001-02-03T00:00:00Z"


def test_resource_records(spark, tmp_path):
    folder = tmp_path / "old"
    folder.mkdir()
    (folder / "IA-1.arc").write_bytes(archives.version_block(1, "n", "20010203040506") + b"\n"
                                      + archives.arc_record(1, "dns:x", "1.2.3.4", "20010203040506", "text/dns", b"1.1.1.1") + b"\n")
    archives.convert(spark, str(folder), str(tmp_path / "new"))
    (row,) = archives.read_warc(spark, str(tmp_path / "new")).collect()
    assert (row.record_type, row.uri, row.date, row.payload_bytes) == ("resource", "dns:x", "2001-02-03T04:05:06Z", 7)


@pytest.mark.parametrize("data", [b"", b"junk", b"filedesc://x", b"http://x/ 1.1.1.1 20010101 t 9999\nshort"])
def test_damaged_archives_give_no_records(data):
    assert list(archives.parse_arc(data)) == []
