"""The pipeline: each stage against plain loops over its own input, and all stages in a row."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import test_mixing
import test_near_copies
import test_token_files
from reqsieve.llm import leaks
from reqsieve.llm.stored import settle


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    first = settle(stages["language id"](spark, docs, sf_dir))
    assert first.columns == columns and rows(first) == rows(docs)  # all of them have letters

    second = settle(stages["near dedup"](spark, first, sf_dir))
    kept = {i for i, _, _, keep in test_near_copies.expected([(r.doc_id, r.text) for r in first.collect()], 5, 80) if keep}
    assert second.columns == columns and rows(second) == rows(first.where(first.doc_id.isin(kept)))

    third = settle(stages["decontamination"](spark, second, sf_dir))
    items = [leaks.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaky = {r.doc_id for r in second.collect() if any(i in leaks.normal(r.text) for i in items)}
    assert third.columns == columns and leaky
    assert rows(third) == rows(second.where(~second.doc_id.isin(leaky)))  # there are no edited items in these tables

    fourth = settle(stages["mixing"](spark, third, sf_dir))
    taken, before = rows(fourth), rows(third)
    assert fourth.columns == columns and set(taken) <= set(before) and max(taken.values()) <= 3
    words = Counter()
    for r in before:
        words[r[3]] += len(r[1].split())
    want = test_mixing.plain_targets(words)
    for s in words:
        got = sum(n * len(r[1].split()) for r, n in taken.items() if r[3] == s)
        assert abs(got - want[s]) <= max(60, 0.05 * want[s])

    last = stages["token files"](spark, fourth, sf_dir)
    expected = test_token_files.expected([(r.doc_id, r.text) for r in fourth.collect()])
    assert test_token_files.ordered(last) == expected
    assert rows(corpus_pipeline.run(spark, sf_dir)) == Counter(expected)


def test_odd_rows_pass(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    benchmark = spark.createDataFrame([(1, "word word word word word word")], "item_id long, text string")
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd.selectExpr("*", "text as language", "source as mark", "1 as shard", "lang as node")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = settle(stage(spark, docs, str(tmp_path)))
        assert made.columns == docs.columns and 0 < made.count() <= 3 * docs.count(), name
        docs = made
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
