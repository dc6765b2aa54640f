"""Ranked search against plain loops over all documents."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from reqsieve.llm import ranked_search
from reqsieve.llm.queries import QUERIES
from reqsieve.llm.stored import setting
from reqsieve.llm.words import hash_word

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, top=50):
    """item_id, rank, doc_id, score by scoring every document."""
    counts = [(i, collections.Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(set)
    for i, text in items:
        if i is not None:
            asked[i] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            scored.append((-score, doc))
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scored)[:top], 1) if s < 0]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def made(seed, n=900):
    """Texts of one to thousands of words, a third of them copies of one, and items made of their words."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)] + ["Été", "été", "日本", "x" * 300]
    def text(size):
        return " ".join(vocabulary[min(len(vocabulary) - 1, int(draw.paretovariate(0.6)))] + draw.choice(["", ",", "-", "!"]) for _ in range(size))
    copy = text(40)
    docs = [(i, copy if draw.random() < 0.33 else text(draw.choice([1, 5, 60, 200, 4000 if i % 50 == 0 else 30]))) for i in range(n)]
    items = [(i, text(draw.choice([1, 8, 30]))) for i in range(40)] + [(90, copy), (91, "nosuchword"), (92, ""), (93, None)]
    return docs, items


DOCS, ITEMS = "doc_id long, text string, item_id long, term string, score int", "item_id long, text string, doc_id long, terms string"


def run(table, docs, items, **options):
    df = table([(i, t, 1, "t", 2) for i, t in docs], DOCS).repartition(3)
    return found(ranked_search.rank_documents(df, table([(i, t, 5, "x") for i, t in items], ITEMS), **options))


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(QUERIES["op12_ranked_search"](spark, sf_dir)) == expected(docs, items)


@pytest.mark.parametrize("seed,top", [(1, 50), (2, 3)])
def test_made_documents(table, seed, top):
    docs, items = made(seed)
    assert run(table, docs, items, top=top) == expected(docs, items, top)


def test_small_blocks_on_both_sides(table, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEM_TERMS", 30)
    docs, items = made(3, 300)
    assert run(table, docs, items, top=5) == expected(docs, items, 5)


def test_bounds_are_never_too_low(monkeypatch):
    """One block with short signatures, so that many bits are set by other terms."""
    draw = random.Random(5)
    words = np.array([draw.getrandbits(64) for _ in range(400)], np.uint64)
    docs = []
    for i in range(100):
        mine = np.sort(np.array(draw.sample(words.tolist(), draw.randint(1, 80)), np.uint64))
        docs.append((i, 500, mine, np.array([draw.choice([1, 1, 1, 2, 3, 4, 9, 40]) for _ in mine])))
    row = next(ranked_search._read(iter([ranked_search._block(256, docs)])))
    asked = np.sort(words[:200])
    items = ranked_search.Items(np.array([1, 2]), asked, [np.arange(0, 200, 3), np.arange(150)], [np.full(67, 7), np.full(150, 3)])
    block = ranked_search._Block(row, items, 100, 50_000)
    exact = np.array(block.scores([np.arange(100)] * 2))
    assert (block.bounds() >= exact).all() and (exact > 0).any()
    for j, (_, _, mine, counts) in enumerate(docs):
        want = dict(zip(mine.tolist(), counts.tolist()))
        assert block.counts(np.array([j]))[:, 0].tolist() == [want.get(t, 0) for t in asked.tolist()]


def test_most_documents_are_excluded_by_their_bounds(spark, sf_dir, monkeypatch):
    asked, scores = [], ranked_search._Block.scores
    monkeypatch.setattr(ranked_search._Block, "scores", lambda self, wanted: asked.append(sum(map(len, wanted))) or scores(self, wanted))
    docs, items = made(6, 3000)
    counts, n_docs = [(i, t) for i, t in docs], len(docs)
    df = spark.createDataFrame(counts, "doc_id long, text string").coalesce(1)
    index = ranked_search.build_index(df).toArrow()
    weighted = [(i, sorted({t for t in terms(x)})) for i, x in items if terms(x)]
    from reqsieve.llm.words import hash_word
    all_terms = np.unique(np.array([hash_word(t.encode()) for _, ts in weighted for t in ts], np.uint64))
    places = [np.searchsorted(all_terms, np.array([hash_word(t.encode()) for t in ts], np.uint64)) for _, ts in weighted]
    block = ranked_search.Items(np.arange(len(weighted)), all_terms, places, [np.full(len(p), 5000) for p in places])
    list(ranked_search._searched(block, n_docs, n_docs * 50, 10, iter(index.to_batches())))
    assert 0 < sum(asked) < 0.6 * n_docs * len(weighted)


def test_odd_rows(table, odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "one, two"), (1, "WORD"), (2, "a b c é"), (2, "a b c é"), (3, None), (None, "one"), (4, " \n"), (5, "xxxx"), (6, "x" * 70_000)]
    assert run(table, docs, items) == expected(docs, items)


def test_empty_tables(table):
    assert run(table, [], [(1, "a")]) == [] and run(table, [(1, "a")], []) == [] and run(table, [(1, None)], [(1, "a")]) == []


def test_the_index_is_read_in_small_pieces(spark):
    """A task holds a row group and a few blocks, whatever its part of the index."""
    draw = random.Random(7)
    docs = [(i, " ".join(f"w{draw.randrange(20_000)}" for _ in range(150))) for i in range(8000)]
    index = ranked_search.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    groups = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert sum(groups) > ranked_search.ROW_GROUP_BYTES > max(groups)


def test_blocks_are_handed_over_a_few_at_a_time(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    key, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(50).coalesce(1)
    before = spark.conf.get(key, None)
    with pytest.raises(ZeroDivisionError), setting(spark, key, str(ranked_search.HANDED_BLOCKS)):
        assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) == ranked_search.HANDED_BLOCKS
        1 / 0
    assert spark.conf.get(key, None) == before and max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) == 50


def test_few_terms_are_asked_for_at_once(table, monkeypatch):
    """Items in groups, and one with more terms than a group in parts, give what all at once give."""
    docs, items = made(8, 400)
    items = [(i, t) for i, t in items if terms(t)] + [(95, " ".join(t for _, t in docs[:40]))]
    wanted = [(i, sorted({hash_word(t.encode()) for t in terms(x)})) for i, x in items]
    all_terms = np.unique(np.array([t for _, ts in wanted for t in ts], np.uint64))
    draw = random.Random(9)
    block = ranked_search.Items(
        np.array([i for i, _ in wanted]), all_terms, [np.searchsorted(all_terms, np.array(ts, np.uint64)) for _, ts in wanted],
        [np.array([draw.randrange(1, 5000) for _ in ts]) for _, ts in wanted])
    batches = ranked_search.build_index(table(docs, "doc_id long, text string").coalesce(1)).toArrow().to_batches()
    monkeypatch.setattr(ranked_search, "ASKED_TERMS", 10**9)
    whole = [b.to_pylist() for b in ranked_search._searched(block, 400, 20_000, 5, iter(batches))]
    monkeypatch.setattr(ranked_search, "ASKED_TERMS", 50)
    asked, bounds = [], ranked_search._Block.bounds
    monkeypatch.setattr(ranked_search._Block, "bounds", lambda self: asked.append(len(self.items.terms)) or bounds(self))
    assert [b.to_pylist() for b in ranked_search._searched(block, 400, 20_000, 5, iter(batches))] == whole
    assert max(asked) <= 50 < max(map(len, block.places)) and len(whole) == len(items) - 1  # a word that no document has
