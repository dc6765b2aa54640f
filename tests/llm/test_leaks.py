"""Benchmark items in documents: Myers against dynamic programming, planted edits, odd rows."""

from __future__ import annotations

import random

import pytest

from reqsieve.llm import leaks
from reqsieve.llm.queries import QUERIES


def distance(pattern, text):
    """Least distance to any part, by the table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        left, row = row, [0]
        for i, p in enumerate(pattern):
            row.append(min(left[i] + (p != c), left[i + 1] + 1, row[i] + 1))
        best = min(best, row[-1])
    return best


def edited(text, errors, draw):
    out = list(text)
    for _ in range(errors):
        at = draw.randrange(len(out))
        kind = draw.choice("idr")
        if kind == "i":
            out.insert(at, draw.choice("abxyz "))
        elif kind == "d":
            del out[at]
        else:
            out[at] = draw.choice("abxyz ")
    return leaks.normal("".join(out))


def test_myers():
    draw = random.Random(1)
    for _ in range(400):
        pattern = "".join(draw.choices("abc", k=draw.randint(5, 80)))
        text = "".join(draw.choices("abc", k=draw.randint(0, 120)))
        if draw.random() < 0.5:
            text = text[:20] + edited(pattern, 3, draw) + text[20:]
        want = distance(pattern, text)
        got = leaks.Myers(pattern).best(text, len(pattern))
        assert (got[0] if got else len(pattern)) == want, (pattern, text)
        assert leaks.Myers(pattern).best(text, want - 1) is None


@pytest.mark.parametrize("percent", [0, 4, 10, 25])
def test_every_match_within_the_budget_is_found(percent):
    draw = random.Random(percent)
    items = [(i, "".join(draw.choices("abcd ", k=draw.randint(25, 90))).strip().replace("  ", " ")) for i in range(12)]
    items = [(i, leaks.normal(t)) for i, t in items]
    finder = leaks.Finder(items, percent)
    for _ in range(60):
        i, item = draw.choice(items)
        text = leaks.normal("".join(draw.choices("abcd ", k=60)) + edited(item, draw.randint(0, 12), draw) + "".join(draw.choices("abcd ", k=60)))
        got = {m[0]: m[1] for m in finder.find(text)}
        want = {j: d for j, t in items if (d := distance(t, text)) <= leaks.budget(len(t), percent)}
        assert got == want
        for j, d, a, b in finder.find(text):
            assert distance(dict(items)[j], text[a:b]) == d and distance(text[a:b], dict(items)[j]) <= d


def test_query(spark, sf_dir):
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op8_leaks"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if leaks.normal(i.text) in leaks.normal(d.text)}
    assert exact and exact == {k for k, d in got.items() if d == 0}
    texts, wanted = {d.doc_id: leaks.normal(d.text) for d in docs}, {i.item_id: leaks.normal(i.text) for i in items}
    for (d, i), n in got.items():
        assert n <= leaks.budget(len(wanted[i]), leaks.EDIT_PERCENT) and distance(wanted[i], texts[d]) == n


ITEM = "The quick brown fox jumps over the lazy dog and runs away into the dark green forest"


def test_odd_rows(spark, odd, table):
    docs = odd.union(table([(50, f"x {ITEM.upper()} y", None, None, None), (51, ITEM.replace("brown", "brwn").replace(" ", "\n\t"), "", "", 0)] * 2, odd.schema))
    items = table([(1, ITEM), (1, ITEM), (2, None), (3, ""), (None, "short"), (4, "word word word word word")], "item_id long, text string")
    docs, items = docs.withColumn("item_id", docs.doc_id), items.withColumn("doc_id", items.item_id)
    got = [tuple(r)[:3] for r in leaks.find_leaks(docs, items).collect()]
    long = [(9, 4, 0)]
    assert sorted(got) == sorted(long + [(50, 1, 0)] * 4 + [(51, 1, 1)] * 4)
    kept = leaks.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 5 and not kept.where("doc_id in (9, 50, 51)").count()
    assert kept.where("doc_id is null").count() == 2


def test_blocks_and_empty_tables(spark, odd, table):
    docs = table([(i, f"a {ITEM} {i}") for i in range(3)], "doc_id long, text string")
    items = table([(i, f"{ITEM} {i}") for i in range(6)], "item_id long, text string")
    one = sorted(map(tuple, leaks.find_leaks(docs, items, percent=2).collect()))
    assert len(one) == 18 and one == sorted(map(tuple, leaks.find_leaks(docs, items, percent=2, block_chars=100).collect()))
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0 and leaks.without_leaks(docs, items.limit(0)).count() == 3
    assert leaks.find_leaks(docs.limit(0), items).count() == 0
    assert leaks.without_leaks(docs, items, percent=2, block_chars=100).count() == 0
