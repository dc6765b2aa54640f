"""Preference ranking: features and fit by plain means, held-out accuracy, odd rows."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from reqsieve.llm import preferences
from reqsieve.llm.queries import QUERIES
from reqsieve.llm.words import slices


def plain_features(text):
    data, words = (text or "").encode(), (text or "").encode().lower().split()
    n = len(words)
    out = [sum(bool(table[b]) for b in data) / max(1, len(data)) for table in preferences._CLASS.values()]
    ends = [w[-1] for w in words]
    out += [
        math.log1p(n) / 10, sum(map(len, words)) / max(1, n) / 10, 1 - len(set(words)) / n if n > 1 else 0,
        1 - len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 0, sum(a == b for a, b in zip(words, words[1:])) / max(1, n),
        data.count(b"\n") / max(1, n), sum(e in b"!?" for e in ends) / max(1, n), sum(e in b"#*$%&|<>" for e in ends) / max(1, n)]
    return out + [math.log1p(50 * x) / math.log(51) for x in out]


@pytest.mark.parametrize("limit", [1, 40, 10_000])
def test_features(limit):
    texts = ["Ab cD\n ab! ab! #tag* 5%", None, "", "  ", "a a a a", "é|ü|", "x", "one two one two", "!!! ???"]
    got = np.concatenate([preferences.features(p) for p in slices(pa.array(texts), limit, lower=False)])
    assert np.allclose(got, [plain_features(t) for t in texts])
    assert got.shape[1] == preferences.WIDTH


def test_fit_is_the_minimum():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(500, 4)) + [0.5, 0, -1, 0.1]
    w = preferences.fit_pairs(x, ridge=0.01)
    chance = 1 / (1 + np.exp(x @ w))
    assert np.abs(-(x * chance[:, None]).mean(axis=0) + 0.01 * w).max() < 1e-6


def test_threshold_is_a_quantile():
    draw = np.random.default_rng(2)
    better, worse = draw.normal(1, 1, size=(900, 3)), draw.normal(-1, 1, size=(100, 3))
    model = preferences.fit(better, worse, 0.1)
    below = (model.strength(np.concatenate([better, worse])) < model.threshold).mean()
    assert below == pytest.approx(0.1, abs=0.002)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op4_preferences"](spark, sf_dir).collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    labels = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(r.predicted == q for r, q in labels) >= 0.95 * len(labels) and {q for _, q in labels} == {0, 1}


def test_nothing_but_the_text_counts(spark, odd, table):
    labels = table([(i, i % 2, 5, "z") for i in range(12)] + [(1, None, 0, "z"), (None, 1, 0, "z"), (3, 7, 0, "z")], "doc_id long, quality int, toxic int, text string")
    first = preferences.rank(odd, labels).collect()
    other = odd.selectExpr("doc_id", "text", "'xx' lang", "'s' source", "1 quality", "'f' features")
    assert sorted(map(str, first)) == sorted(map(str, preferences.rank(other.repartition(3), labels).collect()))
    assert len(first) == odd.count() and all(r.score is not None for r in first)
    assert [r.held_out for r in first if r.doc_id is None] == [False, False]


def test_without_both_labels(spark, odd, table):
    labels = table([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in preferences.rank(odd, labels).collect()} == {(0.5, 1)}
    assert {r.score for r in preferences.rank(odd, labels.limit(0)).collect()} == {0.5}
    assert preferences.rank(odd.limit(0), labels).count() == 0


def _labelled(spark, better, worse):
    rows = [(i, [float(x) for x in row], label) for i, (row, label) in enumerate([(r, 1) for r in better] + [(r, 0) for r in worse])]
    return spark.createDataFrame(rows, "doc_id long, features array<double>, label int"), {1: len(better), 0: len(worse)}


@pytest.mark.parametrize("sizes", [(900, 100), (3, 700)])
def test_fit_takes_every_document(spark, sizes):
    draw = np.random.default_rng(4)
    better, worse = (draw.normal(m, 1, size=(n, preferences.WIDTH)) for m, n in zip((0.1, -0.1), sizes))
    labelled, counts = _labelled(spark, better, worse)
    groups = preferences.dealt(labelled, counts, 200).collect()
    many, few = (better, worse) if len(better) > len(worse) else (worse, better)
    assert sorted(map(tuple, (r for g in groups for r in g.many))) == sorted(map(tuple, many.tolist()))
    assert {tuple(r) for g in groups for r in g.few} == set(map(tuple, few.tolist())) and all(g.few for g in groups)
    for g in groups:
        made = preferences.differences(np.array(g.many), np.array(g.few))
        assert len(made) == len(g.many) * min(preferences.PARTNERS, len(g.few)) or len(made) >= len(g.few)
    model = preferences.fit_all(labelled, counts)
    below = (model.strength(np.concatenate([better, worse])) < model.threshold).sum()
    assert below == len(worse)
    before = model.threshold, model.weights
    far = worse.copy()
    far[0] += 5  # one document more or less is seen
    changed = preferences.fit_all(*_labelled(spark, better, far))
    assert np.abs(changed.weights - before[1]).max() > 1e-6


@pytest.mark.parametrize("most", [3, 10_000])
def test_ranks_by_counts_in_ranges(spark, most):
    draw = np.random.default_rng(5)
    values = np.concatenate([draw.normal(size=300), np.full(200, 0.25), [1e9, -1e9]])
    table, want = spark.createDataFrame([(float(v),) for v in values], "s double"), np.sort(values)
    for rank in (0, 7, 250, 350, len(values) - 2):
        assert preferences.at_ranks(table, rank, most) == (want[rank], want[rank + 1])
