"""Near-copies against all pairs, on the given documents and on made groups."""

from __future__ import annotations

import random

import pytest

from reqsieve.llm import near_copies
from reqsieve.llm.components import components
from reqsieve.llm.queries import QUERIES


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i: i + width]) for i in range(len(words) - width + 1)}


def expected(rows, width=3, percent=85):
    """doc_id, n_shingles, component_id, kept by comparing all pairs; ids are distinct."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if min(len(sets[a]), len(sets[b])) * 100 >= max(len(sets[a]), len(sets[b])) * percent:
                both = len(sets[a] & sets[b])
                if both * 100 >= (len(sets[a]) + len(sets[b]) - both) * percent:
                    lo, hi = sorted((root(a), root(b)))
                    parent[hi] = lo
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


def found(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def edited(words, share, draw):
    return [draw.choice(["q", "z", "y"]) + str(draw.randint(0, 10**6)) if draw.random() < share else w for w in words]


def groups(seed):
    """Bases with copies at all degrees of change, chains of small changes, and a passage in many texts."""
    draw, texts = random.Random(seed), []
    passage = [f"p{i}" for i in range(60)]
    for g in range(6):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.choice([4, 30, 90, 300]))]
        texts += [base] * 3
        texts += [edited(base, draw.random() * 0.07, draw) for _ in range(40)]
        for _ in range(8):
            base = edited(base, 0.02, draw)
            texts.append(base)
    texts += [[f"u{draw.randint(0, 10**9)}" for _ in range(draw.randint(0, 40))] + passage for _ in range(60)]
    texts += [[], ["one"], ["one"], ["One", "two"], ["one", "two"]]
    draw.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op7_near_copies"](spark, sf_dir)) == expected(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_made_groups(spark, table, seed):
    rows = groups(seed)
    df = table(rows, "doc_id long, text string").repartition(4)
    assert found(near_copies.near_copies(df, width=3, percent=85)) == expected(rows)


def test_defaults_take_five_words(spark, table):
    rows = groups(3)
    assert found(near_copies.near_copies(table(rows, "doc_id long, text string"))) == expected(rows, 5, 80)


def test_odd_rows(spark, odd):
    rows = odd.withColumn("node", odd.text).withColumn("n", odd.doc_id)
    got = found(near_copies.near_copies(rows, width=3, percent=85).where("doc_id is not null"))
    once = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    want = expected(dict(once).items())
    assert got == sorted([*want, next(w for w in want if w[0] == 5)])
    nameless = near_copies.near_copies(rows).where("doc_id is null").collect()
    assert [r.component_id for r in nameless] == [None, None] and all(r.kept for r in nameless)


def test_empty_table(spark, table):
    assert near_copies.near_copies(table([], "doc_id long, text string")).count() == 0


def test_one_of_each_group_stays(spark, odd):
    kept = near_copies.keep_one(odd, width=3, percent=85)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11] and ids.count(None) == 2


def test_one_id_with_different_texts(table):
    """Two groups under one id: each keeps one of its texts."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "c d e"), (1, a), (1, a + " "), (5, b)]
    df = table(rows, "doc_id long, text string")
    assert [r[0::2] for r in found(near_copies.near_copies(df))] == [(1, 1)] * 4 + [(2, 1), (3, 1), (4, 4), (5, 1)]
    kept = sorted((r.doc_id, r.text.strip()) for r in near_copies.keep_one(df).collect())
    assert kept == [(1, a), (1, b), (4, "c d e")]


def test_hubs_of_parts(table, monkeypatch):
    monkeypatch.setattr(near_copies, "PARTS", 3)
    rows = groups(4)
    assert found(near_copies.near_copies(table(rows, "doc_id long, text string"), width=3, percent=85)) == expected(rows)


def test_least_overlap():
    assert near_copies.least_overlap(32, 100) == 32
    assert 10 < near_copies.least_overlap(32, 85) < 20


def test_components(spark, table):
    draw = random.Random(5)
    links = [(i, i + 1) for i in range(0, 200)] + [(500, 500 + i) for i in range(100)] + [(draw.randint(1000, 1300), draw.randint(1000, 1300)) for _ in range(200)]
    links += [(7, 7), (None, 3)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {r.node: r.component for r in components(table(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent}
    assert components(table([], "a long, b long")).count() == 0
