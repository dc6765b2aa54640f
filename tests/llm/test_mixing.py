"""Mixing: targets, exact quotas, sums near targets, reruns, odd rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqsieve.llm import mixing
from reqsieve.llm.queries import QUERIES


def plain_targets(sizes):
    """By the contract, with a plain loop."""
    out, fixed = {}, {}
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    while True:
        free = [s for s in names if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        out = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if out[s] > 3 * sizes[s]]
        if not above:
            return out | fixed
        fixed |= {s: 3 * sizes[s] for s in above}


def check(rows, texts):
    """The contract on (doc_id, size, source_size, target, taken) rows; returns the distance from each target."""
    source = {i: s for i, s, _ in texts}
    size = Counter()
    for i, s, t in texts:
        size[s] += len((t or "").encode().split())
    want, taken = plain_targets(size), Counter()
    assert len(rows) == len(texts)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode().split()) for _, _, t in texts)
    return {s: abs(taken[s] - want[s]) for s in size}


def test_query(spark, sf_dir):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()]
    rows = QUERIES["op9_mixing"](spark, sf_dir).collect()
    off = check(rows, texts)
    wanted = {source: r.target for r in rows for i, source, _ in texts if i == r.doc_id}
    assert all(off[s] <= max(5, 0.02 * wanted[s]) for s in off)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op9_mixing"](spark, sf_dir).collect()))


def test_skewed_sources_and_reruns(spark, table):
    draw = random.Random(2)
    names = ["hot"] * 900 + ["b"] * 60 + ["c"] * 30 + [None] * 40 + ["", "é"]
    texts = [(i, s, "w " * draw.randint(1, 80)) for i, s in enumerate(names)]
    df = table(texts, "doc_id long, source string, text string")
    found = mixing.mix_documents(df.repartition(5), block_docs=16, shards=7)
    rows = found.collect()
    assert all(v <= 2 for s, v in check(rows, texts).items() if s in ("hot", "b", "c", None))
    again = mixing.mix_documents(df.orderBy(df.text.desc()).repartition(3), block_docs=16, shards=7).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    epochs = {r.doc_id: sorted(d.epoch for d in r.draws) for r in rows}
    assert all(e == list(range(len(e))) or len(e) <= 1 or e == sorted(set(e)) for e in epochs.values())
    shards = Counter(d.shard for r in rows for d in r.draws)
    assert set(shards) == set(range(7)) and max(shards.values()) < 2 * min(shards.values())


def test_best_fit():
    draw = random.Random(1)
    for _ in range(200):
        sizes = sorted((draw.randint(0, 30) for _ in range(draw.randint(0, 8))), reverse=True)
        room = draw.randint(0, 90)
        sums = {0}
        for x in sizes:
            sums |= {s + x for s in sums}
        taken = mixing.best_fit(sizes, room)
        assert len(set(taken)) == len(taken) and sum(sizes[i] for i in taken) == max(s for s in sums if s <= room)
        assert sum(sizes[i] for i in mixing.best_fit(sizes, room, 20)) <= room


def dealt(spark, quotas, shards, **options):
    df = spark.createDataFrame(list(enumerate(quotas)), "nr long, quota long").where("quota > 0")
    return sorted(map(tuple, mixing.deal(df, sum(quotas), shards, **options).collect()))


def test_quotas_are_exact(spark):
    quotas = [1000, 0, 37, 3, 12345]
    for shards, options in ((1, {}), (2, {}), (7, {"ranges": 2, "groups": 2}), (64, {"ranges": 5, "groups": 3})):
        rows, sizes, at = dealt(spark, quotas, shards, **options), Counter(), Counter()
        for nr, shard, begin, end in sorted(rows, key=lambda r: (r[1], r[0])):
            assert begin == at[nr] < end  # the next stretch of its draws
            at[nr] = end
            sizes[shard] += end - begin
        assert [at[nr] for nr in range(len(quotas))] == quotas
        assert set(sizes) == set(range(shards)) and max(sizes.values()) - min(sizes.values()) <= 1
        assert rows == dealt(spark, quotas, shards, **options)
    assert dealt(spark, [2], 5) and dealt(spark, [], 1) == []


def test_tree_is_hypergeometric():
    """Mean and variance of a quota in a part, against those of draws without putting back."""
    have, draws = np.array([30, 10, 60]), np.array([25, 50, 25])
    found = np.zeros((4000, 3, 3))
    for i in range(len(found)):
        for part, at, n in mixing.split_tree(have, draws, [i]):
            found[i, part, at] = n
    assert (found.sum(axis=1) == have).all() and (found.sum(axis=2) == draws).all()
    share = have / 100
    for part, n in enumerate(draws):
        assert found[:, part].mean(axis=0) == pytest.approx(n * share, rel=0.03)
        assert found[:, part].var(axis=0) == pytest.approx(n * share * (1 - share) * (100 - n) / 99, rel=0.1)


def test_targets(spark):
    def targets(sizes, weights=(1, 2, 3), most=3):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        rows = mixing.with_targets(df, weights, most).collect()
        assert sorted(r.nr for r in rows) == list(range(len(sizes)))
        return {r.source: r.target for r in rows}

    assert targets({"a": 10, "b": 10, "c": 10}, (1, 1, 1)) == {"a": 10, "b": 10, "c": 10}
    assert targets({"a": 1, "b": 100}, (1, 1)) == {"a": 3, "b": 98}
    assert targets({"a": 1, "b": 0, "c": 2}) == pytest.approx({"a": 0.75, "b": 0, "c": 2.25})
    assert targets({}) == {} and targets({"a": 0, None: 0}) == {"a": 0, None: 0}
    assert targets({"a": 5, "b": 5}, most=1) == pytest.approx({"a": 5, "b": 5})
    draw = random.Random(4)
    for _ in range(4):
        sizes = {s: int(10 ** draw.uniform(0, 5)) for s in [None, "", "é", "𝄞", "ﬀ", *(f"s{i}" for i in range(40))]}
        assert targets(sizes) == pytest.approx(plain_targets(sizes))


def test_sums_along_a_source_of_many_ranges(spark):
    rows = [(nr, i * 7919 % 1009, 1 + i % 5) for nr, n in ((0, 900), (1, 3), (2, 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "nr long, at long, v long").repartition(6)
    got = {(r.nr, r.at): r.s for r in mixing.running(df, ["at"], F.col("v"), "s").collect()}
    assert got == {(nr, at): sum(v for n, a, v in rows if n == nr and a <= at) for nr, at, _ in rows}


def test_many_sources(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id)) as source", "repeat('w ', cast(1 + id % 9 as int)) as text")
    rows = mixing.mix_documents(docs, block_docs=64).select("source", "size", "source_size", "target", "taken").collect()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(rows) == 3000 and len(size) == 2001 and target == pytest.approx(plain_targets(size))
    assert abs(taken["hot"] - target["hot"]) <= 1 and all(r.taken <= 3 * r.size for r in rows)
    assert all(taken[s] <= round(target[s]) + 1 for s in size)


def test_rows_are_copied_as_drawn(spark, odd):
    docs = odd.withColumn("target", odd.lang)
    rows = mixing.mixed_rows(docs, block_docs=2, shards=2)
    assert rows.columns == ["document", "epoch", "shard", "order"] and rows.select("document.*").columns == docs.columns
    got = Counter(r.document for r in rows.collect())
    by = mixing.mix_documents(docs, block_docs=2, shards=2).collect()
    assert sum(got.values()) == sum(len(r.draws) for r in by)
    assert all(n <= 6 for n in got.values())
    shards = mixing.mixed_documents(docs, block_docs=2, shards=2)
    assert shards.columns == docs.columns and Counter(shards.collect()) == got
    off = Counter()
    for r in by:
        off[r.source, r.target] += r.taken
    assert {s for s, _ in off} == {"a", "b", None}


def test_empty_table(spark, odd):
    assert mixing.mix_documents(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd.limit(0)).count() == 0
