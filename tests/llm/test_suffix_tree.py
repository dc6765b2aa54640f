"""Suffix tree scores: counts and base by brute force, the automaton against the definition, held-out quality."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reqsieve.llm import suffix_tree
from reqsieve.llm.queries import QUERIES
from reqsieve.llm.words import slices


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def words(text):
    return (text or "").encode().lower().split()


def base(rows):
    """By id: tokens, known tokens, tokens of training, base score."""
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*words(t), None])
    n, v, out = sum(c.values()), len(c), []
    for i, t in rows:
        tokens = [*words(t), None]
        out.append((i, held(i), len(tokens), sum(c[x] > 0 for x in tokens), n,
                    sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)))
    return out


def sequence(text):
    return b" ".join(words(text)) + b"\xff"


def plain_tree(rows, depth, share, divergence):
    """Kept contexts by the definition."""
    counts = [Counter() for _ in range(depth + 1)]
    total = 0
    for i, t in rows:
        if not held(i):
            s = b"\xff" + sequence(t)
            for k in range(1, len(s)):
                total += 1
                for d in range(min(depth, k) + 1):
                    counts[d][s[k - d: k], s[k]] += 1
    follow = {}
    for level in counts:
        for (context, x), n in level.items():
            follow.setdefault(context, {})[x] = n
    kept = {b"": follow.get(b"", {})}
    for context, following in follow.items():
        n = sum(following.values())
        if context and n >= share * total:
            suffix = follow[context[1:]]
            m = sum(suffix.values())
            if sum(c / n * math.log(c / n / (suffix[x] / m)) for x, c in following.items()) >= divergence:
                kept[context] = following
    return kept


def plain_score(kept, text, depth, k=suffix_tree.SMOOTHING):
    def chance(context, x):
        before = 1 / 257
        if context:
            before = chance(next(context[a:] for a in range(1, len(context) + 1) if context[a:] in kept), x)
        following = kept[context]
        weight = k * max(1, len(following))
        return (following.get(x, 0) + weight * before) / (sum(following.values()) + weight)

    s, out = b"\xff" + sequence(text), 0.0
    for at in range(1, len(s)):
        longest = next(s[at - d: at] for d in range(min(depth, at), -1, -1) if s[at - d: at] in kept)
        out += math.log10(chance(longest, s[at]))
    return out


ORDER = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def check(df, rows, **options):
    got = sorted((tuple(r) for r in suffix_tree.score(df, **options).select(ORDER).collect()), key=repr)
    want = sorted(base(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    kept = plain_tree(rows, options["depth"], options["share"], options["divergence"])
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(plain_score(kept, t, options["depth"]))
    for g in got:
        assert any(math.isclose(g[6], s, rel_tol=1e-4) for s in texts[g[0]]), g
    return kept


def test_against_the_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    kept = check(docs.repartition(3), rows, depth=3, share=0.001, divergence=0.05, head_words=50)
    assert {len(c) for c in kept} == {0, 1, 2, 3}


@pytest.mark.parametrize("most,most_grams", [(30, 0), (30, 60), (0, 1_000_000), (400, 500)])
def test_contexts_outside_the_broadcast_tree_count(spark, sf_dir, most, most_grams):
    """What is broadcast changes no score: contexts beyond it are joined, and none is too rare."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 30").select("doc_id", "text")
    rows = [(r.doc_id, r.text[:600]) for r in docs.collect()] + [(1000, None), (1001, "ÿ zq"), (1002, "a"), (1002, "a"), (None, "b a")]
    assert any(held(i) for i, _ in rows)
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = check(made, rows, depth=4, share=0.0, divergence=0.05, head_words=50, most=most, most_grams=most_grams)
    assert len(kept) > 2000


def test_defaults_keep_rare_contexts(spark):
    """A context of one position in 250,000 is in the model."""
    rows = [(i, "ab " * 900) for i in range(100) if not held(i)] + [(1000, "zyxwv")]
    assert not held(1000)
    got = {r.doc_id: r.score for r in suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = plain_tree(rows, suffix_tree.DEPTH, 0.0, suffix_tree.LEAST_DIVERGENCE)
    assert {b"z", b"y", b"x", b"w"} <= set(kept)
    assert math.isclose(got[1000], plain_score(kept, "zyxwv", suffix_tree.DEPTH), rel_tol=1e-4)


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(odd.withColumn("n", odd.doc_id).withColumn("score", odd.text), rows, depth=2, share=0.001, divergence=0.01, head_words=5)


def test_empty_and_held_out_only(spark, table):
    assert suffix_tree.score(table([], "doc_id long, text string")).count() == 0
    only = next(i for i in range(100) if held(i))
    (row,) = suffix_tree.score(table([(only, "a b")], "doc_id long, text string")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert math.isclose(row.score, 4 * math.log10(1 / 257), rel_tol=1e-5) and math.isclose(row.base_score, 0.0, abs_tol=1e-9)


def test_query_beats_the_base(spark):
    """From a thousand documents on: the base needs no letters to score a word it has never seen."""
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op3_suffix_tree"](spark, sf_dir).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {w[0]: w for w in base(docs)}
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][1:5]
        assert math.isclose(r.base_score, want[r.doc_id][5], rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("limit", [1, 30, 10_000])
def test_sequences(limit):
    texts = ["A b", None, "", " x  y\n", "é", "  "]
    out = []
    for part in slices(pa.array(texts), limit):
        data, begins = suffix_tree.sequence(part.words())
        out += [data[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:])]
    assert out == [sequence(t) for t in texts]
