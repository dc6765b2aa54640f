"""The operators that SQL can express against it, and the two on lines against plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from check import compare, connect
from reqsieve.llm import line_rules, line_windows
from reqsieve.llm.queries import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, name) is None


def windows_by_loop(rows):
    """Kept text and removed lines by (id, text), first occurrences in the order of ids."""
    first, out = {}, {}
    for i, text in sorted(set(rows), key=lambda r: r[0]):
        lines = text.split("\n") if text is not None else []
        shown = [(k, line.strip(" ").lower()) for k, line in enumerate(lines) if line.strip(" ")]
        gone = set()
        for a, b, c in zip(shown, shown[1:], shown[2:]):
            key = (a[1], b[1], c[1])
            if key not in first:
                first[key] = (i, c[0])
            else:
                gone |= {p for p in (a[0], b[0], c[0]) if first[key][0] != i or p > first[key][1]}
        out[i, text] = ("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text, len(lines), len(gone))
    return out


def test_windows_by_loop(spark, table):
    draw = random.Random(4)
    rows = [(i, "\n".join(draw.choice([" A", "a ", "b", "c", "D", "", " ", "e", f"u{draw.randint(0, 99)}"]) for _ in range(draw.randint(0, 25)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "x\ny"), (203, "\n".join(["same"] * 7)), (204, "\n".join(["same"] * 5))]
    df = table([(i, t, 1) for i, t in [*rows, rows[3], rows[3]]], "doc_id long, text string, line int").repartition(4)
    got = line_windows.drop_repeated_windows(df)
    assert got.columns == ["doc_id", "text", "line", "n_lines", "n_removed"]
    want = windows_by_loop(rows)
    counted = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect())
    assert counted == Counter((i, *want[i, t]) for i, t in [*rows, rows[3], rows[3]])
    assert (203, "same\nsame\nsame", 7, 4) in counted


def test_windows_of_odd_rows(spark, odd):
    got = line_windows.drop_repeated_windows(odd.withColumn("removed", odd.n_chars).withColumn("n_lines", odd.lang))
    assert got.count() == odd.count() and got.columns == [*odd.columns, "removed", "n_lines", "n_removed"]
    assert {r.n_removed for r in got.collect()} == {0}
    both = odd.where("doc_id = 10")
    nameless = both.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars")
    rows = line_windows.drop_repeated_windows(both.union(nameless)).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {10: 0, None: 4}
    assert line_windows.drop_repeated_windows(odd.limit(0)).count() == 0


SPACE = " \t\n\x0b\x0c\r"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rules_by_loop(rows, share, least, lost):
    """By (id, host, text)."""
    docs, hosts, lines = set(rows), Counter(), defaultdict(set)
    for r in docs:
        hosts[r[1]] += 1
        for line in (r[2] or "").split("\n"):
            lines[r[1], line.strip(SPACE).lower()].add(r)
    out = {}
    for r in docs:
        text, words = r[2] or "", split(r[2])
        shown = [x for x in text.split("\n") if split(x)]
        three = Counter(zip(words, words[1:], words[2:]))
        again = {p for k, w in enumerate(zip(words, words[1:], words[2:])) if three[w] > 1 for p in (k, k + 1, k + 2)}
        gone = sum(len(split(x)) for x in shown if (n := len(lines[r[1], x.strip(SPACE).lower()])) > least and n > share * hosts[r[1]])
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        out[r] = (r[0], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(shown) - len(set(shown)), len(again),
                  failed, gone, not failed and 100 * gone <= lost * len(words))
    return Counter(out[r] for r in rows)


def test_rules_by_loop(spark, table):
    draw = random.Random(6)
    common = ["Share this page with all your friends now", " all rights\treserved by the owner ", "#tag *bold* $5 100% a&b |<x>"]
    rows = []
    for i in range(120):
        body = [" ".join(f"w{draw.randint(0, 60 if i % 5 else 3)}" for _ in range(draw.randint(0, 15))) for _ in range(draw.randint(0, 12))]
        body += [draw.choice(common) for _ in range(draw.randint(0, 6))]
        draw.shuffle(body)
        rows.append((i, ["a", "a", "b", None][i % 4], draw.choice(["\n", " \n", "\r\n"]).join(body)))
    rows += [(500, "a", None), (501, "a", ""), (502, "a", " \n\t"), (503, None, "x" * 9000), (None, None, None), (None, "a", "é ü ß"), rows[4], rows[4], rows[5]]
    df = table(rows, "doc_id long, source string, text string").repartition(3).selectExpr("*", "1 as n_words", "'x' as lines")
    got = Counter(tuple(r) for r in line_rules.rules(df, line_docs=3, line_share=0.2, lost_percent=30).collect())
    assert got == rules_by_loop(rows, 0.2, 3, 30)
    assert {k[8] for k in got} == {True, False} and any(k[7] for k in got)


def test_rules_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.source, r.text) for r in odd.collect()]
    got = Counter(tuple(r) for r in line_rules.rules(odd).collect())
    assert got == rules_by_loop(rows, line_rules.LINE_SHARE, line_rules.LINE_DOCS, line_rules.LOST_PERCENT)
    assert line_rules.rules(odd.limit(0)).count() == 0


def without_by_loop(rows, share, least, lost):
    """The kept rows (id, host, text) without their frequent lines."""
    docs, hosts, lines = set(rows), Counter(), defaultdict(set)
    for r in docs:
        hosts[r[1]] += 1
        for line in (r[2] or "").split("\n"):
            lines[r[1], line.strip(SPACE).lower()].add(r)
    kept = {v[0] for v in rules_by_loop(rows, share, least, lost) if v[-1]}
    stays = lambda h, x: not split(x) or (n := len(lines[h, x.strip(SPACE).lower()])) <= least or n <= share * hosts[h]
    return Counter((i, h, "\n".join(x for x in t.split("\n") if stays(h, x))) for i, h, t in rows if i in kept)


def pages_of_hosts():
    """A hot host whose lines are frequent at production parameters, and a small one; some documents are mostly such lines."""
    draw, rows = random.Random(8), []
    common = ["Share this page with all your friends now", " ALL rights\treserved by the owner\r", "menu home about contact help"]
    for i, host in enumerate(["hot"] * 400 + ["small"] * 90):
        own = [" ".join(f"w{draw.randint(0, 5000)}" for _ in range(12)) for _ in range(5)]
        body = [*own, "", *draw.sample(common, 2), *([" ".join(f"l{k}" for k in range(90))] if i % 3 == 0 else [])]
        draw.shuffle(body)
        rows.append((i, host, "\n".join(body)))
    return rows


def test_documents_without_frequent_lines(spark, table):
    rows = pages_of_hosts()
    rows += [rows[1], rows[1], (900, "hot", None), (901, "hot", "")]
    df = table([(*r, 7) for r in rows], "doc_id long, source string, text string, removed int").repartition(3)
    got = line_rules.without_frequent_lines(df)
    assert got.columns == df.columns
    kept = got.collect()
    assert Counter((r.doc_id, r.source, r.text) for r in kept) == without_by_loop(rows, line_rules.LINE_SHARE, line_rules.LINE_DOCS, line_rules.LOST_PERCENT)
    verdicts, text = {r.doc_id: r for r in line_rules.rules(df).collect()}, {r[0]: r[2] for r in rows}
    assert {r.doc_id for r in kept} == {i for i, v in verdicts.items() if v.kept}
    assert all(len(split(text[r.doc_id])) - len(split(r.text)) == verdicts[r.doc_id].n_removed_words for r in kept)
    assert line_rules.without_frequent_lines(df.limit(0)).count() == 0


def test_odd_rows_without_frequent_lines(spark, odd):
    got = line_rules.without_frequent_lines(odd.withColumn("kept", odd.lang))
    ids = {r.doc_id for r in line_rules.rules(odd).where("kept").collect()}
    assert got.columns == [*odd.columns, "kept"] and {r.doc_id for r in got.collect()} == ids


def test_production_limits(spark, table):
    """Lines go and documents are rejected in the hot host; a host with no more than LINE_DOCS documents loses nothing."""
    rows = pages_of_hosts()
    got = line_rules.rules(table(rows, "doc_id long, source string, text string")).collect()
    assert Counter(map(tuple, got)) == rules_by_loop(rows, line_rules.LINE_SHARE, line_rules.LINE_DOCS, line_rules.LOST_PERCENT)
    hot = [r for r in got if r.doc_id < 400]
    assert all(r.n_removed_words for r in hot) and {r.kept for r in hot if not r.base_failed} == {True, False}
    assert not any(r.n_removed_words for r in got if r.doc_id >= 400)
