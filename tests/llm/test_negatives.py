"""Hard negatives against plain loops over whole numbers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqsieve.llm import negatives
from reqsieve.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, q string, norm int, score string"


def expected(rows):
    """Rows of (vec_id, embedding, label), in Python's own integers."""
    usable = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in usable:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in usable)
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
            hard = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(hard[:3], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def made(seed, n=700, width=70, longest=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0.2, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = [longest * (c + draw.gauss(0, 0.6)) / 10 for c in draw.choice(centres)]
        rows.append((i, v if draw.random() < 0.7 else centres[0], draw.randint(0, 3)))  # a third is one vector
    return rows


def run(table, rows, **options):
    df = table([(i, v, label, "q", 1, "s") for i, v, label in rows], VECTORS).repartition(3)
    return found(negatives.mine(df, label=negatives.shifted_label(), **options))


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(QUERIES["op11_negatives"](spark, sf_dir)) == expected(rows)


@pytest.mark.parametrize("seed,longest", [(1, 1.0), (2, 400.0)])
def test_made_vectors(table, seed, longest):
    rows = made(seed, longest=longest)
    want = expected(rows)
    assert len(want) > 50 and run(table, rows) == want


def test_blocks_and_tiles(table, monkeypatch):
    rows = made(3, n=400)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 8 * 70 * 3)  # three anchors to a block
    assert run(table, rows) == expected(rows)


def test_best_keeps_the_order_over_tiles():
    draw = np.random.default_rng(4)
    scores, best = draw.integers(-5, 6, (9, 500)), negatives.Best(9, 4)
    ids, allowed = draw.permutation(500), draw.random((9, 500)) < 0.5
    for at in range(0, 500, 60):
        order = np.argsort(ids[at: at + 60])
        best.add(np.arange(9), scores[:, at: at + 60][:, order], allowed[:, at: at + 60][:, order], ids[at: at + 60][order])
    for i in range(9):
        want = sorted((-s, j) for s, j, a in zip(scores[i], ids, allowed[i]) if a)[:4]
        assert [(-s, j) for s, j in zip(best.score[i], best.id[i])] == want


@pytest.mark.parametrize("size", [1, 300, 40_000])
def test_scores_are_exact(size):
    draw = np.random.default_rng(size)
    rows, anchors = draw.integers(-size, size + 1, (40, 2500)), draw.integers(-size, size + 1, (7, 2500))
    primes = negatives.primes_for(size * size * 2500)
    assert (negatives.exact_scores(rows, anchors, primes) == anchors @ rows.T).all()
    assert (negatives.exact_scores(-np.abs(rows), np.abs(anchors), primes) == np.abs(anchors) @ -np.abs(rows).T).all()


def test_odd_rows(table):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.6], 2), (3, [], 2), (4, None, 2), (5, [None, 1.0], 2),
            (6, [float("nan"), 1.0], 2), (8, [float("inf"), 1.0], 2), (9, [0.7, 0.3], None), (None, [0.7, 0.3], 2), (10, [0.7, 0.3], 2),
            (11, [0.7, 0.3], 2), (12, [0.7, 0.3], 3), (13, [0.4, 0.2], 3), (50, [-1.0, -1.0], 2), (100, None, 2)]
    got = run(table, rows)
    assert got == expected(rows)
    assert [r[:4] for r in got if r[0] == 0] == [(0, i, 1, 13) for i in (2, 2, 10, 10, 11, 11)]  # the anchor is there twice


def test_empty_table_and_no_anchor(spark, table):
    assert run(table, []) == []
    assert run(table, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_long_vectors_are_refused(table):
    with pytest.raises(ValueError, match="longer"):
        run(table, [(0, [3e30], 1)])


def test_other_anchors_and_labels(table):
    rows = [(i, [1.0 - i / 100], i % 2) for i in range(8)]
    df = table([(i, v, label, "q", 1, "s") for i, v, label in rows], VECTORS)
    got = found(negatives.mine(df, anchor=F.col("vec_id") == 3, positives=1, negatives=2, window=(0, 99)))
    assert [r[:4] for r in got] == [(3, 1, 1, 2), (3, 1, 2, 4)]
