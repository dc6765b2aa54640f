"""Hard negatives by matrix products in a residue number system (operator 11).

1. Every component x becomes the whole number floor(256 * x), so scores are whole numbers too. The longest vector
   bounds every score (Cauchy and Schwarz), and the bound says how many primes are needed.
2. Anchors come in blocks of a bounded number of bytes. Each block is sent to the tasks, which multiply its residues
   modulo every prime with those of their rows, in float32: residues lie around zero and the dimensions are taken
   in pieces, so that no sum leaves the whole numbers that float32 has. Chinese remaindering gives the signed scores.
3. A first pass finds each anchor's best rows of its label, a second one the best rows of other labels inside each
   positive's window of scores. A task keeps the few best rows for each anchor of the block, ranks within a tile by
   one number made of score and place, and gives them out at its end; a rank over anchors merges the tasks.

So a block costs one reading of the rows for each pass, tasks hold a block and a tile, and what is shuffled is a few
rows for each anchor and task. Rows are never moved, and pairs of rows never leave the task that scores them.

Exact for vectors of a length up to 2^25 steps of 1/256 (131,072); longer ones have scores that are not safe in
64 bits once multiplied by 100, and are refused with a ``ValueError``.

Defined results: rows with a null id, a null label, a null vector or a component that is null or not finite take no
part. An empty vector scores 0 with all, a shorter one counts as padded with zeros. "Other" rows are those with
another id; of rows that share an id, each counts. Repeated anchors give their rows once each. Ties go by the smaller
id. Other columns are ignored. An empty table gives no rows; anchors without positives, and positives without
negatives in their window, give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqsieve.llm.stored import only, settle
from reqsieve.session import shared_dir
from reqsieve.sources.requests import spread

#: Steps of a component, positives of an anchor, negatives of a positive; the window in percent of the positive's score.
STEPS, POSITIVES, NEGATIVES, WINDOW = 256, 5, 3, (50, 95)
#: The residues are taken modulo the first of these that are needed.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)
#: Bytes of the whole numbers of a block of anchors; a block is what a task and the driver hold at a time.
BLOCK_BYTES = 16 << 20
#: The longest vector, in steps.
LONGEST = 1 << 25
#: Rows and anchors of a tile of scores. A place in a tile has as many values as it has rows.
TILE_ROWS, TILE_ANCHORS = 2048, 512
#: Dimensions in a piece: a sum of so many products of two residues is exact in float32.
PIECE = (1 << 24) // (max(PRIMES) // 2) ** 2

_NONE = np.iinfo(np.int64).min


def primes_for(bound: int) -> tuple[int, ...]:
    """The primes whose product tells all whole numbers from -bound to bound apart."""
    product = 1
    for n, p in enumerate(PRIMES):
        product *= p
        if product > 2 * bound:
            return PRIMES[: n + 1]
    raise ValueError(f"scores up to {bound} need more than {len(PRIMES)} primes")


def residues(vectors: np.ndarray, prime: int) -> np.ndarray:
    """Residues around zero, as float32."""
    half = prime // 2
    return ((vectors + half) % prime - half).astype(np.float32)


def exact_scores(rows: np.ndarray, anchors: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """``anchors @ rows.T`` in whole numbers, by products of residues and mixed-radix remaindering."""
    total, base = np.zeros((len(anchors), len(rows)), np.int64), 1
    for prime in primes:
        left, right = residues(anchors, prime), residues(rows, prime).T
        product = np.zeros(total.shape, np.int32)
        for at in range(0, rows.shape[1], PIECE):
            product += (left[:, at: at + PIECE] @ right[at: at + PIECE]).astype(np.int32) % np.int32(prime)
        digit = (product - (total % prime).astype(np.int32)) * np.int32(pow(base, -1, prime)) % np.int32(prime)
        total += digit.astype(np.int64) * base
        base *= prime
    return np.where(total > base // 2, total - base, total)


class Best:
    """The best few rows of each of ``n`` lists, by score and then by the smaller id."""

    def __init__(self, n: int, keep: int) -> None:
        self.score = np.full((n, keep), _NONE)
        self.id = np.full((n, keep), np.iinfo(np.int64).max)

    def add(self, lists: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Rows in ascending order of ids, at most ``TILE_ROWS``; scores and allowed: a line for each of the lists."""
        keep = self.score.shape[1]
        allowed = allowed & (scores >= self.score[lists, -1][:, None])
        hit = allowed.any(axis=1)
        if not hit.any():
            return
        lists, place = lists[hit], np.arange(TILE_ROWS - 1, TILE_ROWS - 1 - len(ids), -1)
        keys = np.where(allowed[hit], scores[hit] * TILE_ROWS + place, _NONE)
        if keys.shape[1] > keep:
            keys = np.partition(keys, keys.shape[1] - keep, axis=1)[:, -keep:]
        found = keys != _NONE
        score = np.concatenate((self.score[lists], np.where(found, keys // TILE_ROWS, _NONE)), axis=1)
        where = np.where(found, TILE_ROWS - 1 - keys % TILE_ROWS, 0)
        rid = np.concatenate((self.id[lists], np.where(found, ids[where], np.iinfo(np.int64).max)), axis=1)
        order = np.lexsort((rid, -np.maximum(score, -(1 << 62))), axis=1)[:, :keep]
        self.score[lists] = np.take_along_axis(score, order, 1)
        self.id[lists] = np.take_along_axis(rid, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, ids and scores of what was found."""
        at = np.nonzero(self.score != _NONE)
        return at[0], self.id[at], self.score[at]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix, shorter lists padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of some rows, by ascending id."""
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(at, TILE_ROWS)
            ids = part.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            yield ids[order], part.column(1).to_numpy()[order], _matrix(part.column(2), width)[order]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``vec_id, label, q, norm`` of the rows that take part; norm: the squared length, rounded up."""
    values = F.col("v").cast("array<double>")
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(STEPS))))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * F.lit(float(STEPS)) + 1, F.lit(2.0)))
    rows = only(vectors, vec_id=F.col(f"`{id_col}`").cast("long"), label=label.cast("long"), v=F.col(f"`{vector_col}`")).withColumn("v", values)
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(usable)
    return rows.select("vec_id", "label", whole.cast("array<long>").alias("q"), length.alias("norm"))


def _blocks(anchors: DataFrame, width: int) -> Iterator[pa.Table]:
    """The anchors in blocks of a bounded size, one at a time on the driver."""
    each = max(1, BLOCK_BYTES // (8 * max(1, width)))
    numbered = settle(anchors.withColumn("nr", F.monotonically_increasing_id()))
    # one task's numbers have no gaps, so a range of numbers holds what its ends in the tasks tell
    sizes = numbered.groupBy(F.shiftright("nr", 33).alias("part")).agg(F.min("nr").alias("lo"), F.max("nr").alias("hi")).orderBy("part")
    first, last, room = None, None, each
    for part in sizes.toLocalIterator():  # one row for each task that wrote anchors
        at = part.lo
        while at <= part.hi:
            took = min(room, part.hi - at + 1)
            first = at if first is None else first
            last, at, room = at + took - 1, at + took, room - took
            if room == 0:
                yield numbered.where(F.col("nr").between(first, last)).toArrow()
                first, room = None, each
    if first is not None:
        yield numbered.where(F.col("nr").between(first, last)).toArrow()


def _first(df: DataFrame, by: list[str], score: str, tie: str, keep: int) -> DataFrame:
    ranked = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return df.withColumn("rank", ranked).where(F.col("rank") <= keep)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
         anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
         window: tuple[int, int] = WINDOW) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``label``: by default the column of that name. ``anchor``: a condition on ``vec_id``, by default that 50 divides it.
    ``window``: least and greatest score of a negative, in percent of the positive's.
    """
    spark = vectors.sparkSession
    rows = settle(quantised(vectors, id_col, vector_col, F.col("label") if label is None else label))
    size = rows.agg(F.max("norm"), F.max(F.size("q"))).first()
    longest, width = size[0] or 0.0, size[1] or 0
    if longest > float(LONGEST) ** 2:
        raise ValueError(f"a vector is longer than {LONGEST} steps of 1/{STEPS}")
    primes = primes_for(math.ceil(longest * 1.0000001) + 1)
    chosen = rows.where(F.col("vec_id") % 50 == 0 if anchor is None else anchor).select("vec_id", "label", "q")
    many = spread(rows.select("vec_id", "label", "q"))
    path = shared_dir(spark)
    spark.createDataFrame([], RESULT).write.parquet(path)
    for block in _blocks(chosen, width):
        _mine_block(spark, many, block, width, primes, positives, negatives, window).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "slot long, id long, score long"


def _mine_block(spark, many: DataFrame, block: pa.Table, width: int, primes: tuple[int, ...], positives: int, negatives: int,
                window: tuple[int, int]) -> DataFrame:
    block = block.combine_chunks()
    q = block.column("q").chunk(0) if block.num_rows else pa.array([], pa.list_(pa.int64()))
    sent = spark.sparkContext.broadcast((block.column("vec_id").to_numpy(), block.column("label").to_numpy(), _matrix(q, width)))

    def same_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, anchors = sent.value
        best = Best(len(anchor_ids), positives)
        for ids, labels, rows in _tiles(batches, width):
            for one in np.unique(labels):
                mine_, theirs = np.flatnonzero(anchor_labels == one), np.flatnonzero(labels == one)
                for at in range(0, len(mine_), TILE_ANCHORS):
                    lists = mine_[at: at + TILE_ANCHORS]
                    scores = exact_scores(rows[theirs], anchors[lists], primes)
                    best.add(lists, scores, ids[theirs] != anchor_ids[lists][:, None], ids[theirs])
        yield from _given(best)

    ranked = settle(_first(many.mapInArrow(same_label, FOUND), ["slot"], "score", "id", positives))
    found = ranked.select("slot", "id", "score", "rank").toArrow()  # a few rows for each anchor of the block
    slots, place = found.column("slot").to_numpy(), found.column("rank").to_numpy() - 1
    least, most = np.ones((block.num_rows, positives), np.int64), np.zeros((block.num_rows, positives), np.int64)
    score = found.column("score").to_numpy()
    least[slots, place], most[slots, place] = -(-score * window[0] // 100), score * window[1] // 100
    windows = spark.sparkContext.broadcast((least, most))

    def other_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, anchor_labels, anchors = sent.value
        least_, most_ = windows.value
        best = Best(len(anchors) * positives, negatives)
        for ids, labels, rows in _tiles(batches, width):
            for at in range(0, len(anchors), TILE_ANCHORS):
                some = np.arange(at, min(at + TILE_ANCHORS, len(anchors)))
                scores = exact_scores(rows, anchors[some], primes)
                other = labels != anchor_labels[some][:, None]
                for j in range(positives):
                    inside = other & (scores >= least_[some, j][:, None]) & (scores <= most_[some, j][:, None])
                    best.add(some * positives + j, scores, inside, ids)
        yield from _given(best)

    hard = _first(many.mapInArrow(other_labels, FOUND), ["slot"], "score", "id", negatives)
    hard = hard.select(F.expr(f"slot div {positives}").alias("slot"), (F.col("slot") % positives + 1).alias("at"),
                       F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = spark.createDataFrame(
        pa.table({"slot": np.arange(block.num_rows), "anchor_id": block.column("vec_id")}))
    good = ranked.select("slot", F.col("rank").cast("long").alias("at"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(good, ["slot", "at"]).join(named, "slot").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _given(best: Best) -> Iterator[pa.RecordBatch]:
    slots, ids, scores = best.rows()
    for at in range(0, len(slots), 65_536):
        part = slice(at, at + 65_536)
        yield pa.record_batch([pa.array(slots[part]), pa.array(ids[part]), pa.array(scores[part])], ["slot", "id", "score"])


def shifted_label() -> Column:
    """The label that the query mines by: one further, modulo 10, where 7 divides the id."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


ORACLE = r"""
with usable as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as q
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as anchor_id, r.vec_id as id, r.label = a.label as same,
           list_inner_product(a.q, r.q)::bigint as score
    from usable a join usable r on a.vec_id % 50 = 0
), positive as (
    select anchor_id, id as positive_id, score as positive_score from scored where same and id <> anchor_id
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
), negative as (
    select p.anchor_id, p.positive_id, p.positive_score, s.id as negative_id, s.score as negative_score,
           row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) as rank
    from positive p join scored s on s.anchor_id = p.anchor_id and not s.same
     and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from negative where rank <= 3
"""
