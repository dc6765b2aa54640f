"""Ranked lexical search over bit-sliced Bloom signatures (operator 12).

Index. Every document becomes a Bloom signature of its terms; a term that occurs 2, 4 or 8 times is put in once more
for each of these levels. Documents with signatures of one length stand side by side in blocks, and a block is stored
by slices: one bitmap over its documents for each bit of the signature. With a block go the documents' ids, numbers
of terms and greatest term counts, the block's terms with the number of documents that hold them, and each
document's terms with their counts.

Search. Items come in blocks of a bounded number of terms, each sent to the tasks. A task takes the slices of a term,
and what is set in all of them are the documents that may hold it so many times: never too few. The level's greatest
count and the document's length give the most that the term can add to a score, and their weighted sum over an item's
terms bounds the score. Documents whose bound does not reach the item's last place in the task are left out, all
others are scored exactly from the stored counts; those with the highest bounds go first. A rank over items merges
the tasks.

So the documents' texts are read once, to build the index, and a block of items costs one reading of the index; what
is shuffled is ``top`` rows for each item and task. Scores are whole numbers in 64 bits. A task's memory does not grow with
what it reads: texts come in slices, the index in small row groups and a few blocks at a time, and a block is asked for a
bounded number of terms at once.

Terms are told apart by 64-bit hashes of their bytes.

Defined results: a null or empty text has no terms; such documents are not counted, such items give no rows. Rows
without an id are left out on both sides, before anything is counted. The terms of rows with one item id are put
together. Repeated documents are ranked once each. Equal scores go by the smaller id. Other columns are ignored. An
empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqsieve.llm.stored import only, settle, setting
from reqsieve.llm.words import Slice, Words, lists, mix, signed, slices
from reqsieve.session import shared_dir

#: Documents that an item is given.
TOP = 50
#: Bits of a signature for each entry, and bits that an entry sets.
BITS, PROBES = 8, 3
#: Term counts from which a term is one entry more.
LEVELS = (1, 2, 4, 8)
#: Documents of a block, and the most bytes of its slices.
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
#: Terms of the items that are searched for in one reading of the index.
ITEM_TERMS = 16_384
#: Of these, terms that a block is asked for at once.
ASKED_TERMS = 2048
#: Text bytes that are turned into arrays at a time.
SLICE_BYTES = 250_000
#: Bytes of a row group of the stored index, and blocks of it that Spark hands to a task at a time.
ROW_GROUP_BYTES, HANDED_BLOCKS = 4 << 20, 4

_TERM = np.zeros(256, bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = True
_TERM[0x80:] = True

INDEX = ("bits long, ids array<long>, lengths array<long>, most array<int>, slices binary, terms array<long>, held array<int>, "
         "bounds array<int>, places array<int>, counts array<int>")


def terms_of(part: Slice) -> Words:
    """Maximal runs of ASCII letters, digits and bytes above 0x7F."""
    inside = _TERM[part.data]
    cuts = np.zeros(len(part.data) + 1, bool)
    cuts[part.bounds] = True
    before = np.concatenate(([False], inside[:-1]))[: len(inside)]
    after = np.concatenate((inside[1:], [False]))[: len(inside)]
    starts = np.flatnonzero(inside & (~before | cuts[:-1]))
    return Words(part, inside, starts, np.flatnonzero(inside & (~after | cuts[1:])) + 1, np.searchsorted(starts, part.bounds))


def probes(terms: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bits that each term sets at a level: a line of ``PROBES`` for each."""
    h = mix(terms.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def _bits_for(counts: np.ndarray) -> int:
    entries = sum(int((counts >= least).sum()) for least in LEVELS)
    return BITS << max(3, (entries - 1).bit_length())


def _block(bits: int, docs: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row of the index."""
    sizes = [len(d[2]) for d in docs]
    terms, places = np.unique(np.concatenate([d[2] for d in docs]), return_inverse=True)
    counts, of = np.concatenate([d[3] for d in docs]), np.repeat(np.arange(len(docs)), sizes)
    slices_ = np.zeros((bits, -(-len(docs) // 8)), np.uint8)
    for level, least in enumerate(LEVELS):
        enough = counts >= least
        where = probes(terms, level, bits)[places[enough]]
        for lane in range(8):  # within a lane equal places get equal values, so none is lost
            mine = of[enough] % 8 == lane
            slices_[where[mine], (of[enough][mine] // 8)[:, None]] |= np.uint8(128 >> lane)

    def one(values, kind):
        return lists(np.asarray(values).astype(kind), np.array([0, len(values)]))

    return pa.record_batch([
        pa.array([bits]), one([d[0] for d in docs], np.int64), one([d[1] for d in docs], np.int64),
        one([d[3].max() for d in docs], np.int32), pa.array([slices_.tobytes()], pa.binary()), one(signed(terms), np.int64),
        one(np.bincount(places, minlength=len(terms)), np.int32), one(np.concatenate(([0], np.cumsum(sizes))), np.int32),
        one(places, np.int32), one(counts, np.int32)], names=[c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of all documents with an id and a term, written to the shared folder."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(1), SLICE_BYTES):
                found = terms_of(part)
                words, which = np.unique(found.hashes(), return_inverse=True)
                sizes = np.diff(found.bounds)
                pairs, counts = np.unique(np.repeat(np.arange(len(part)), sizes) * max(1, len(words)) + which, return_counts=True)
                of, which = pairs // max(1, len(words)), pairs % max(1, len(words))
                cuts = np.searchsorted(of, np.arange(len(part) + 1))
                for i in np.flatnonzero(sizes):
                    mine = slice(cuts[i], cuts[i + 1])
                    bits = _bits_for(counts[mine])
                    docs_ = waiting.setdefault(bits, [])
                    docs_.append((int(ids[part.first + i]), int(sizes[i]), words[which[mine]], counts[mine].astype(np.int32)))
                    if len(docs_) >= min(BLOCK_DOCS, max(8, 8 * BLOCK_BYTES // bits)):
                        yield _block(bits, waiting.pop(bits))
        for bits in sorted(waiting):
            yield _block(bits, waiting[bits])

    texts = only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
    small_groups = {"parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size.row.check.min": "1"}  # rows are large, so each is looked at
    return settle(texts.where("doc_id is not null and text is not null").mapInArrow(rows, INDEX), small_groups)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, term``: each term of an item once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(1), SLICE_BYTES):
                found = terms_of(part)
                of = np.repeat(ids[part.first: part.first + len(part)], np.diff(found.bounds))
                yield pa.record_batch([pa.array(of, pa.int64()), pa.array(signed(found.hashes()))], ["item_id", "term"])

    texts = only(items, item_id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
    return texts.where("item_id is not null and text is not null").mapInArrow(rows, "item_id long, term long").distinct()


@dataclass
class Items:
    """Some items: their ids, all their terms, and for each item the places of its terms and these terms' weights."""

    ids: np.ndarray
    terms: np.ndarray
    places: list[np.ndarray]
    weights: list[np.ndarray]

    def few(self) -> Iterator[tuple[slice, list[Items]]]:
        """Some of the items at a time, with at most ``ASKED_TERMS`` terms; one item with more comes in several parts."""
        first, n = 0, 0
        for i, places in enumerate([*self.places, None]):
            if places is None or n + len(places) > ASKED_TERMS:
                if i > first:
                    yield slice(first, i), [self._part(first, i, lo) for lo in range(0, n, ASKED_TERMS)]
                first, n = i, 0
            n += 0 if places is None else len(places)

    def _part(self, first: int, last: int, lo: int) -> Items:
        cut = slice(lo, lo + ASKED_TERMS) if last - first == 1 else slice(None)
        mine = [p[cut] for p in self.places[first:last]]
        used = np.unique(np.concatenate(mine))
        return Items(self.ids[first:last], self.terms[used], [np.searchsorted(used, p) for p in mine], [w[cut] for w in self.weights[first:last]])


def _item_blocks(weighted: DataFrame) -> Iterator[Items]:
    """Items with about ``ITEM_TERMS`` terms at a time; an item of more is a block of its own."""
    some, n = [], 0

    def packed() -> Items:
        terms = np.unique(np.concatenate([np.array([t.term for t in r.terms]) for r in some]))
        found = [(np.searchsorted(terms, [t.term for t in r.terms]), np.array([t.weight for t in r.terms], np.int64)) for r in some]
        return Items(np.array([r.item_id for r in some]), terms.astype(np.int64).view(np.uint64), [f[0] for f in found], [f[1] for f in found])

    for row in weighted.toLocalIterator():
        if some and n + len(row.terms) > ITEM_TERMS:
            yield packed()
            some, n = [], 0
        some.append(row)
        n += len(row.terms)
    if some:
        yield packed()


class _Block:
    """A row of the index, asked for the terms of some items."""

    def __init__(self, row: dict, items: Items, n_docs: int, n_terms: int) -> None:
        self.ids, lengths = row["ids"], row["lengths"]
        self.norm = 50 + 50 * lengths * n_docs // n_terms
        self.items, self.row = items, row

    def part(self, counts: np.ndarray, docs: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What a term with these counts gives, before its weight."""
        return 1_000_000_000 * counts // (1000 * counts + 20 * self.norm[docs])

    def bounds(self) -> np.ndarray:
        """For every item and document a number that its score does not exceed."""
        bits, n = self.row["bits"], len(self.ids)
        slices_ = np.frombuffer(self.row["slices"], np.uint8).reshape(bits, -1)
        most, below = self.row["most"].astype(np.int64), np.zeros(n, np.int64)
        total, may = np.zeros((len(self.items.terms), n), np.int32), None
        for level, least in enumerate(LEVELS):
            found = np.bitwise_and.reduce(slices_[probes(self.items.terms, level, bits)], axis=1)
            may = found if may is None else may & found
            last = level + 1 == len(LEVELS)
            above = self.part(most if last else np.minimum(most, LEVELS[level + 1] - 1))
            total += np.unpackbits(may, axis=1, count=n) * (above - below).astype(np.int32)
            below = above
        # whole numbers below 2^53, so float64 has them exactly
        return np.array([w.astype(float) @ total[p].astype(float) for p, w in zip(self.items.places, self.items.weights)]).astype(np.int64)

    def counts(self, docs: np.ndarray) -> np.ndarray:
        """How often each of the items' terms is in some documents."""
        terms = self.row["terms"].view(np.uint64)
        at = np.minimum(np.searchsorted(terms, self.items.terms), len(terms) - 1)
        asked = np.full(len(terms), -1)
        hit = terms[at] == self.items.terms
        asked[at[hit]] = np.flatnonzero(hit)
        lo, hi = self.row["bounds"][docs], self.row["bounds"][docs + 1]
        of = np.repeat(np.arange(len(docs)), hi - lo)
        entries = np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        which = asked[self.row["places"][entries]]
        out = np.zeros((len(self.items.terms), len(docs)), np.int32)
        out[which[which >= 0], of[which >= 0]] = self.row["counts"][entries[which >= 0]]
        return out

    def scores(self, wanted: list[np.ndarray]) -> list[np.ndarray]:
        """Exact scores of the documents that each item wants."""
        docs = np.unique(np.concatenate(wanted))
        counts, out = self.counts(docs), []
        for mine, places, weights in zip(wanted, self.items.places, self.items.weights):
            some = counts[places][:, np.searchsorted(docs, mine)].astype(np.int64)
            out.append((weights[:, None] * self.part(some, mine)).sum(axis=0))
        return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {}
            for name, column in zip(batch.schema.names, batch.columns):
                value = column[i]
                row[name] = value.values.to_numpy() if pa.types.is_list(column.type) else value.as_buffer() if name == "slices" else value.as_py()
            yield row


def _searched(items: Items, n_docs: int, n_terms: int, top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best_score = [np.zeros(0, np.int64) for _ in items.ids]
    best_id = [np.zeros(0, np.int64) for _ in items.ids]
    few = list(items.few())

    def search_block(row: dict, some: slice, parts: list[Items]) -> None:
        blocks = [_Block(row, part, n_docs, n_terms) for part in parts]
        bounds = sum(block.bounds() for block in blocks)
        done = np.zeros(bounds.shape, bool)
        for first in (True, False):  # the highest bounds, then what they do not exclude
            wanted = []
            for k, bound in enumerate(bounds):
                i, open_ = some.start + k, (bound > 0) & ~done[k]
                if len(best_id[i]) == top:
                    open_ &= (bound > best_score[i][-1]) | ((bound == best_score[i][-1]) & (row["ids"] < best_id[i][-1]))
                mine = np.flatnonzero(open_)
                if first and len(mine) > top:
                    mine = np.sort(mine[np.argpartition(bound[mine], -top)[-top:]])
                done[k, mine] = True
                wanted.append(mine)
            if not any(map(len, wanted)):
                continue
            for i, mine, *scores in zip(range(some.start, some.stop), wanted, *(block.scores(wanted) for block in blocks)):
                scores = sum(scores)
                held = scores > 0
                score, ids = np.concatenate((best_score[i], scores[held])), np.concatenate((best_id[i], row["ids"][mine[held]]))
                order = np.lexsort((ids, -score))[:top]
                best_score[i], best_id[i] = score[order], ids[order]

    for row in _read(batches):
        for some, parts in few:
            search_block(row, some, parts)
    for item, score, ids in zip(items.ids.tolist(), best_score, best_id):
        if len(ids):
            yield pa.record_batch([pa.array([item] * len(ids), pa.int64()), pa.array(ids), pa.array(score)], ["item_id", "doc_id", "score"])


RESULT = "item_id long, rank int, doc_id long, score long"


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the highest-scoring documents of an index for each item."""
    spark = index.sparkSession
    n_docs, n_terms = index.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    path = shared_dir(spark)
    spark.createDataFrame([], "item_id long, doc_id long, score long").write.parquet(path)
    if n_docs:
        held = index.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(
            F.sum(F.col("t.held").cast("long")).alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(n_docs).cast("long") + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
        weighted = settle(item_terms(items, id_col, text_col).join(held, "term").groupBy("item_id").agg(
            F.collect_list(F.struct("term", weight.alias("weight"))).alias("terms")))
        for block in _item_blocks(weighted):
            sent = spark.sparkContext.broadcast(block)
            with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(HANDED_BLOCKS)):
                index.drop("held").mapInArrow(
                    lambda batches: _searched(sent.value, n_docs, n_terms, top, batches), "item_id long, doc_id long, score long"
                ).write.mode("append").parquet(path)
    found = spark.read.schema("item_id long, doc_id long, score long").parquet(path)
    ranked = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", ranked).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The highest-scoring ones of ``docs`` (``doc_id, text``) for each of ``items`` (``item_id, text``)."""
    return search(build_index(docs), items, top=top)


ORACLE = r"""
with of_docs as (
    select row_number() over () as nr, doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from documents where doc_id is not null
), of_items as (
    select distinct item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark where item_id is not null
), counts as (select nr, doc_id, term, count(*) as tf from of_docs group by all
), lengths as (select nr, sum(tf)::bigint as n from counts group by nr
), totals as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from lengths
), held as (select term, count(*) as df from counts group by term
), weights as (
    select i.item_id, i.term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w
    from of_items i join held using (term), totals
), scored as (
    select w.item_id, c.doc_id, sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (100 - 50 + ((50 * l.n * t.n_docs) // t.n_terms)))))::bigint as score
    from weights w join counts c using (term) join lengths l using (nr), totals t group by w.item_id, c.nr, c.doc_id
), ranked as (
    select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""
