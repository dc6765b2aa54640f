"""Set joins against all pairs, on the given documents and on made groups."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqsieve.llm import set_join
from reqsieve.llm.queries import QUERIES


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i: i + width]) for i in range(len(words) - width + 1))


def expected(rows, width=3, percent=90):
    """doc_id, n_shingles, component_id by comparing all pairs of different sets."""
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    different = list({s for i, s in sets if s and i is not None})
    least = {s: min(i for i, x in sets if x == s and i is not None) for s in different}
    parent = list(range(len(different)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(different):
        for y in range(x):
            b = different[y]
            if min(len(a), len(b)) * 100 >= max(len(a), len(b)) * percent:
                both = len(a & b)
                if both * 100 >= (len(a) + len(b) - both) * percent:
                    parent[root(x)] = root(y)
    group = {}
    for x, s in enumerate(different):
        group[root(x)] = min(group.get(root(x), least[s]), least[s])
    place = {s: x for x, s in enumerate(different)}
    return sorted(((i, len(s), group[root(place[s])] if s and i is not None else i) for i, s in sets), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def edited(words, share, draw):
    return [draw.choice("qzy") + str(draw.randint(0, 10**6)) if draw.random() < share else w for w in words]


def groups(seed):
    """Bases with copies at all degrees of change, chains of small changes, mixes of a few passages."""
    draw, texts = random.Random(seed), []
    for size in (4, 30, 90, 300, 900):
        base = [f"w{draw.randint(0, 400)}" for _ in range(size)]
        texts += [base] * 3
        texts += [edited(base, draw.random() * 0.04, draw) for _ in range(40)]
        for _ in range(12):
            base = edited(base, 0.012, draw)
            texts += [base, base + [f"end{draw.randint(0, 99)}"], base[1:]]
    passages = [[f"p{k}x{i}" for i in range(60)] for k in range(8)]
    for _ in range(120):
        some = draw.sample(passages, draw.randint(1, 6))
        texts.append([f"u{draw.randint(0, 10**9)}" for _ in range(draw.randint(0, 12))] + [w for p in some for w in p])
    texts += [[], ["one"], ["one"], ["One", "two"], ["one", "two"]]
    draw.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


DOCS = "doc_id long, text string"


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op13_set_join"](spark, sf_dir)) == expected(rows)


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 90), (2, 5, 80), (3, 3, 95)])
def test_made_groups(table, seed, width, percent):
    rows = groups(seed)
    got = found(set_join.join_sets(table(rows, DOCS).repartition(4), width=width, percent=percent))
    assert got == expected(rows, width, percent)


def test_answers_of_followers(table, monkeypatch):
    """Two leaders that are no link, whose followers are: words of their own make every set a chosen one."""
    monkeypatch.setattr(set_join, "RADIUS", 4)
    asked = []
    derived = set_join._derived
    monkeypatch.setattr(set_join, "_derived", lambda *a: asked.append(1) or derived(*a))
    for seed in range(3):
        draw, rows = random.Random(seed), []
        base = [f"b{i}" for i in range(400)]
        for side in range(2):  # two sides that are just too far apart, with followers towards each other and away
            at = draw.sample(range(0, 400, 8), 7)
            mine = [f"s{side}y{i}" if i in at else w for i, w in enumerate(base)]
            rows.append(mine)
            for _ in range(15):
                back = draw.sample(at, 2)
                rows.append([base[i] if i in back else w for i, w in enumerate(mine)])
        rows = [(i, " ".join(r)) for i, r in enumerate(draw.sample(rows, len(rows)))]
        assert found(set_join.join_sets(table(rows, DOCS), width=3, percent=90)) == expected(rows)
    assert asked


def test_derived_answers_are_exact(spark):
    draw = random.Random(8)
    sets = {k: sorted(draw.sample(range(300), 200)) for k in range(6)}
    held = spark.createDataFrame([(k, v) for k, v in sets.items()], "node long, shingles array<long>")
    answers = spark.createDataFrame([(0, 5, 200, len(set(sets[0]) & set(sets[5])))], "u long, v long, nv long, common long")
    followers = spark.createDataFrame([(0, k, 0.1) for k in (1, 2)], "a long, b long, far double")
    leading = spark.createDataFrame([(0,)], "node long")
    made = set_join._derived(answers, set_join._deltas(leading, followers, held), held)
    assert {r.y: r.common for r in made.collect()} == {k: len(set(sets[k]) & set(sets[5])) for k in (0, 1, 2)}


def test_odd_bits_never_differ_by_more_than_the_sets():
    draw = np.random.default_rng(3)
    for share in (0.01, 0.1, 0.5):
        a, b = draw.integers(-2**63, 2**63, 700), draw.integers(-2**63, 2**63, 700)
        b = np.where(draw.random(700) < share, b, a)
        bits = [np.frombuffer(set_join.odd_bits(np.unique(x)), np.uint64) for x in (a, b)]
        differ = len(set(a.tolist()) ^ set(b.tolist()))
        assert differ / 4 < np.bitwise_count(bits[0] ^ bits[1]).sum() <= differ


def test_large_group_is_split(table, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", 4)
    draw = random.Random(4)
    passages = [[f"p{k}x{i}" for i in range(30)] for k in range(5)]
    rows = [(i, " ".join([f"u{draw.randint(0, 10**9)}"] * draw.randint(0, 2) + [w for p in draw.sample(passages, 3) for w in p])) for i in range(150)]
    assert found(set_join.join_sets(table(rows, DOCS), width=3, percent=90)) == expected(rows)


def test_candidates_grow_with_a_group_and_not_with_its_square(table, monkeypatch):
    made, pairs = [], set_join._block_pairs

    def counted(*args, **options):
        found = set_join.settle(pairs(*args, **options))
        made.append(found.count())
        return found

    monkeypatch.setattr(set_join, "_block_pairs", counted)
    draw = random.Random(1)
    base, rows = [f"b{i}" for i in range(150)], []
    for i in range(600):
        at = draw.sample(range(150), draw.choice([1, 2]))
        rows.append((i, " ".join(f"e{draw.randint(0, 10**9)}" if k in at else w for k, w in enumerate(base))))
    assert found(set_join.join_sets(table(rows, DOCS), width=3, percent=90)) == expected(rows)
    assert sum(made) <= 12 * len(rows)


@pytest.mark.parametrize("crowd,block", [(2, 4), (3, 20), (10, 1000)])
def test_first_comparisons_lose_no_link(table, monkeypatch, crowd, block):
    monkeypatch.setattr(set_join, "CROWD", crowd)
    monkeypatch.setattr(set_join, "BLOCK", block)
    rows = groups(5)
    assert found(set_join.join_sets(table(rows, DOCS).repartition(4), width=3, percent=90)) == expected(rows)


def test_blocks_that_are_far_apart_are_not_opened(spark):
    odd = set_join.odd_bits(np.arange(400))
    rows = [(7, i, i, 400, 10, 0.0, odd) for i in range(50)] + [(7, 100 + i, 100 + i, 400, 39, 0.0, odd) for i in range(50)]
    rows += [(7, 200, 200, 400, 10, 0.0, set_join.odd_bits(np.arange(50, 450))), (7, 201, 201, 400, 10, 0.0, set_join.odd_bits(np.arange(10, 410)))]
    entries = spark.createDataFrame(rows, "value long, node long, component long, n long, pos long, reach double, odd binary")
    blocks = set_join._blocks(entries, 90)
    assert blocks.count() == 2
    plan = set_join._block_pairs(blocks, 90)
    # first ones may differ by 10 + 10 hashes of 42, the others would by 39 + 39, or by 10 + 39; 200 differs by 100 from all, 201 by 20
    assert {(r.a, r.b) for r in plan.collect()} == {(a, b) for b in [*range(50), 201] for a in range(min(b, 50))}


def test_one_id_with_different_texts(table):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "c d e")]
    got = found(set_join.join_sets(table(rows, DOCS)))
    assert got == expected(rows, 5, 80)
    assert [r[2] for r in got] == [1, 1, 1, 1, 4]


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    clashing = odd.withColumn("node", F.col("text")).withColumn("n", F.col("doc_id")).withColumn("least", F.lit("x")).withColumn("key1", F.lit(1))
    assert found(set_join.join_sets(clashing, width=3, percent=90)) == expected(rows)


def test_empty_table(table):
    assert set_join.join_sets(table([], DOCS)).count() == 0
    assert found(set_join.join_sets(table([(1, None), (2, " ")], DOCS))) == [(1, 0, 1), (2, 0, 2)]
