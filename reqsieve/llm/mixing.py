"""Sources mixed to target weights (operator 9).

Sources in code-point order (null last) get weights in turn and share the words of the whole corpus; no target
exceeds ``MOST_REPEATS`` times its source, and what is cut off there is shared out again. A source whose target is
e times its words and a rest takes e whole passes over its documents and the rest from one more.

Documents belong to blocks by a hash of their ids, about ``BLOCK_DOCS`` in each, so the blocks of any source are of
about one size and no task sees a source whole. In every pass the blocks come in another pseudo-random order. The
last pass ends inside one block; of that block those documents are taken that fill the rest best.

That makes a quota of block draws for each source. A splitting tree halves the output shards again and again, and
draws the left half's part of every quota from the multivariate hypergeometric distribution, which keeps all quotas
exact. A shard's part of a source is the next stretch of its draws, so draws are disjoint. Rows have an ``order``
by which a shard is sorted, a hash, which mixes its sources.

Sources, blocks and shards are tables of their own and stay on the executors. Targets come from sums over the sources, as many
as it takes until no more of them reach their limit. The tree deals groups of sources out to ranges of shards first, a table
of at most ``GROUPS`` by ``RANGES`` on the driver; then a task per group deals its sources out to the ranges, and a task per
range to its shards. Groups have the totals that the tree gave them, which leaves the distribution as it is. Sums along a
source's blocks go over sorted ranges of rows, so a source of any size is spread. A mix has fewer than 10^9 draws of blocks.

Defined results: a null text has no words. A null id is told apart by its text. Rows with one id are always taken
together. A source without words takes nothing; an empty table gives no rows. Everything follows from the
rows and the seed: reruns agree, in whatever order the rows are read. Other columns are kept by ``mixed_rows`` and ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqsieve.llm.stored import only, settle
from reqsieve.llm.words import slices
from reqsieve.operators.reports import numbered

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK_DOCS = 256
#: Text bytes that are turned into arrays at a time.
SLICE = 400_000
#: Draws of blocks that make up an output shard.
SHARD_DRAWS = 1024
#: Groups of sources and ranges of shards that the tree deals with first.
GROUPS = 256
RANGES = 256
SEED = 42


def word_counts(docs: DataFrame, text_col: str, size_col: str) -> DataFrame:
    """The documents without their text, but with the number of its words."""
    columns = [c for c in docs.columns if c != text_col]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.get_field_index(text_col)
            sizes = [np.diff(part.words().bounds) for part in slices(batch.column(text), SLICE)]
            sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.record_batch([*[batch.column(batch.schema.get_field_index(c)) for c in columns], pa.array(sizes, pa.int64())],
                                  [*columns, size_col])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != text_col)
    return docs.mapInArrow(rows, f"{kinds}, `{size_col}` long")


def with_targets(sources: DataFrame, weights: tuple[float, ...], most: float = MOST_REPEATS) -> DataFrame:
    """``source, size`` (unique sources) with ``nr``, their place, and ``target``, what each is to contribute.

    By weight, none above ``most`` times its size, all words in sum if possible: ``target = min(level * weight, most * size)``.
    The level rises with the sources that have reached their limit, until no others do.
    """
    placed = numbered(sources.withColumn("__null", F.col("source").isNull()), "__null", "source")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights)).cast("int"))
    weighed = placed.withColumn("nr", F.col("n") - 1).withColumn("__weight", weight).withColumn("__limit", F.col("size") * most).drop("n", "__null")
    sums = weighed.agg(F.sum("size").alias("size"), F.sum("__weight").alias("weight")).first()
    level, before = (sums.size / sums.weight, 0) if sums.weight else (0.0, 0)
    while sums.weight:
        full = weighed.where(F.lit(level) * F.col("__weight") > F.col("__limit")).agg(
            F.count("*").alias("n"), F.sum("__limit").alias("limit"), F.sum("__weight").alias("weight")).first()
        if full.n <= before:
            break
        before, open_ = full.n, sums.weight - full.weight
        level = (sums.size - full.limit) / open_ if open_ > 0 else float("inf")
    target = F.least(F.lit(level) * F.col("__weight"), F.col("__limit").cast("double"))
    return weighed.withColumn("target", target).drop("__weight", "__limit")


def split_tree(have: np.ndarray, draws: np.ndarray, seed: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Deal quotas out to parts that take so many draws each: a part, the places of its quotas and how much of them.

    Parts are halved again and again; the left half's share of every quota is multivariate hypergeometric. Parts come in order, and
    what a part has nothing of is left out.
    """
    up_to = np.concatenate([[0], np.cumsum(draws)])

    def split(first: int, last: int, at: np.ndarray, have: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not len(at):
            return
        if last - first == 1:
            yield first, at, have
            return
        middle = (first + last) // 2
        left = np.random.default_rng([*seed, first, last]).multivariate_hypergeometric(have, int(up_to[middle] - up_to[first]), method="marginals")
        for begin, end, part in ((first, middle, left), (middle, last, have - left)):
            yield from split(begin, end, at[part > 0], part[part > 0])

    have = np.asarray(have, np.int64)
    yield from split(0, len(draws), np.flatnonzero(have), have[have > 0])


def deal(quotas: DataFrame, total: int, shards: int, seed: int = SEED, groups: int = GROUPS, ranges: int = RANGES) -> DataFrame:
    """Quotas (``nr, quota``, ``total`` in sum) as ``nr, shard, begin, end``: a shard gets the draws from begin up to end.

    All of every quota is dealt out; shards differ by a draw at most.
    """
    ranges = min(ranges, shards)
    cuts = [r * shards // ranges for r in range(ranges + 1)]

    def up_to(shard: int) -> int:
        return shard * (total // shards) + min(shard, total % shards)  # the first shards take the draws that do not divide evenly

    grouped = settle(quotas.withColumn("group", F.expr(f"cast(pmod(nr, {groups}) as int)")))
    sums = sorted(tuple(r) for r in grouped.groupBy("group").agg(F.sum("quota")).collect())  # one row per group
    of_group = {g: np.zeros(ranges, np.int64) for g, _ in sums}
    room = np.array([up_to(end) - up_to(begin) for begin, end in zip(cuts, cuts[1:])], np.int64)
    for r, at, n in split_tree(np.array([q for _, q in sums], np.int64), room, [seed, 0]):
        for i, x in zip(at, n):
            of_group[sums[i][0]][r] = x

    def dealt(nr: np.ndarray, have: np.ndarray, begin: np.ndarray, draws: np.ndarray, tree: list[int], first: int, part: str) -> pd.DataFrame:
        begin, out = begin.copy(), [pd.DataFrame({"nr": [], part: [], "begin": [], "end": []}, dtype=np.int64)]
        for p, at, n in split_tree(have, draws, tree):
            out.append(pd.DataFrame({"nr": nr[at], part: first + p, "begin": begin[at], "end": begin[at] + n}))
            begin[at] += n
        return pd.concat(out)

    def over_ranges(rows: pd.DataFrame) -> pd.DataFrame:
        rows, group = rows.sort_values("nr"), int(rows["group"].iloc[0])
        nr = rows["nr"].to_numpy()
        return dealt(nr, rows["quota"].to_numpy(), np.zeros(len(nr), np.int64), of_group[group], [seed, 1, group], 0, "range")

    def over_shards(rows: pd.DataFrame) -> pd.DataFrame:
        rows, r = rows.sort_values("nr"), int(rows["range"].iloc[0])
        draws = np.diff([up_to(s) for s in range(cuts[r], cuts[r + 1] + 1)])
        begin = rows["begin"].to_numpy()
        return dealt(rows["nr"].to_numpy(), rows["end"].to_numpy() - begin, begin, draws, [seed, 2, r], cuts[r], "shard")

    of_range = settle(grouped.groupBy("group").applyInPandas(over_ranges, "nr long, range long, begin long, end long"))
    return of_range.groupBy("range").applyInPandas(over_shards, "nr long, shard long, begin long, end long").withColumn("shard", F.col("shard").cast("int"))


def running(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of a value over a source's rows up to and with each one, in a unique order.

    Rows are cut into sorted ranges, which split big sources; a range is summed up by itself, and what a source has in the ranges
    before it is added.
    """
    ranged = settle(rows.repartitionByRange("nr", *order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("nr", "__part").agg(F.sum(value).alias("__sum"))
    earlier = F.sum("__sum").over(Window.partitionBy("nr").orderBy("__part")) - F.col("__sum")
    inside = F.sum(value).over(Window.partitionBy("nr", "__part").orderBy(*order))
    return ranged.join(sums.select("nr", "__part", earlier.alias("__before")), ["nr", "__part"]).withColumn(
        name, F.col("__before") + inside).drop("__part", "__before")


def best_fit(sizes: list[int], room: int, fine: int = 200_000) -> list[int]:
    """Which of some sizes, given largest first, to take to fill the room as far as possible.

    Beyond ``fine`` they are taken as they come; below, all sums are tried, as bits of one integer.
    """
    taken, rest = [], []
    for i, size in enumerate(sizes):
        if size <= room and room > fine:
            taken.append(i)
            room -= size
        elif size <= room:
            rest.append(i)
    reached, full = [1], (1 << room + 1) - 1
    for i in rest:
        reached.append((reached[-1] | reached[-1] << sizes[i]) & full)
    total = reached[-1].bit_length() - 1
    for i, before in zip(reversed(rest), reversed(reached[:-1])):
        if not before >> total & 1:
            taken.append(i)
            total -= sizes[i]
    return sorted(taken)


@dataclass
class Mix:
    """``sources``: source, nr, source_size, target, blocks, passes, rest. ``draws``: nr, block, draws. ``picks``: nr, mark."""

    sources: DataFrame
    draws: DataFrame
    picks: DataFrame
    seed: int


def _mark(id_col: str, text_col: str) -> Column:
    return F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("text"), F.col(text_col))).otherwise(F.xxhash64(F.col(id_col).cast("string")))


def _placed(docs: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Documents (source, mark, ...) with the number of their source and their block."""
    numbered = sources.select(F.col("source").alias("__source"), "nr", "blocks", "source_size", "target")
    return docs.join(numbered, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn(
        "block", F.expr(f"pmod(xxhash64({seed}, mark), blocks)"))


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, block_docs: int = BLOCK_DOCS,
         shards: int | None = None, seed: int = SEED) -> Mix:
    """The mix of documents given as ``source, mark, size``."""
    found = settle(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")))
    size, target, passes = F.col("size"), F.col("target"), F.col("passes")
    full = F.when(size > 0, F.least(F.lit(most), F.floor(target / size))).otherwise(0).cast("int")
    rest = F.when((size > 0) & (passes < most), F.greatest(F.lit(0), F.round(target).cast("long") - passes * size)).otherwise(0).cast("long")
    # Written down, as the other tables of a mix, so that Spark knows their sizes.
    sources = settle(with_targets(found, weights, most).withColumn("passes", full).select(
        "source", "nr", size.alias("source_size"), "target", F.ceil(F.col("docs") / block_docs).alias("blocks"), "passes", rest.alias("rest")))

    placed = _placed(sized, sources, seed)
    totals = placed.groupBy("nr", "block").agg(F.sum("size").alias("words"))
    last = totals.join(sources.select("nr", "passes", "rest"), "nr").withColumn("at", F.expr(f"xxhash64({seed + 1}, nr, passes, block)"))
    blocks = settle(  # a row per block
        running(last, ["at", "block"], F.col("words"), "up_to").withColumn("before", F.col("up_to") - F.col("words"))
        .withColumn("last", F.col("before") < F.col("rest"))
        .withColumn("gap", F.when(F.col("last") & (F.col("up_to") > F.col("rest")), F.col("rest") - F.col("before"))))
    runs = F.when(F.col("last"), F.col("passes") + 1).otherwise(F.col("passes"))
    drawn = blocks.where(runs > 0).select("nr", "block", "gap", "passes", F.explode(F.sequence(F.lit(0), runs - 1)).alias("epoch"))
    drawn = drawn.withColumn("partial", (F.col("epoch") == F.col("passes")) & F.col("gap").isNotNull()).withColumn(
        "at", F.expr(f"xxhash64({seed + 1}, nr, epoch, block)"))
    slots = settle(running(drawn, ["epoch", "at", "block"], F.lit(1), "slot").withColumn("slot", F.col("slot") - 1))

    total = slots.count()
    stretches = deal(slots.groupBy("nr").agg(F.count("*").alias("quota")), total, shards or max(1, total // SHARD_DRAWS), seed)
    of_slot = stretches.select("nr", "shard", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("slot"))
    draws = settle(slots.join(of_slot, ["nr", "slot"]).groupBy("nr", "block").agg(  # a few passes at most
        F.array_sort(F.collect_list(F.struct("epoch", "shard", "partial"))).alias("draws")))

    def fitting(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(less=-rows["words"]).sort_values(["nr", "less", "mark"])
        nrs, words, marks, gaps = [rows[c].to_numpy() for c in ("nr", "words", "mark", "gap")]
        begins = np.flatnonzero(np.diff(nrs, prepend=nrs[0] - 1))
        taken = [begin + i for begin, end in zip(begins, [*begins[1:], len(nrs)]) for i in best_fit(words[begin:end].tolist(), int(gaps[begin]))]
        return pd.DataFrame({"nr": nrs[taken], "mark": marks[taken]}, dtype=np.int64)

    ends = blocks.where("gap is not null").select("nr", "block", "gap")
    picks = settle(  # one block of each source
        placed.join(ends, ["nr", "block"]).groupBy("nr", "mark", "gap").agg(F.sum("size").alias("words"))
        .groupBy(F.expr(f"pmod(nr, {GROUPS})")).applyInPandas(fitting, "nr long, mark long"))
    return Mix(sources, draws, picks, seed)


def drawn(docs: DataFrame, mix: Mix) -> DataFrame:
    """Documents (source, mark, ...) with ``draws``, an array of epoch and shard: empty if the mix leaves them out."""
    placed = _placed(docs, mix.sources, mix.seed).join(mix.draws, ["nr", "block"], "left").join(
        mix.picks.withColumn("picked", F.lit(True)), ["nr", "mark"], "left")
    held = F.filter(F.coalesce("draws", F.array().cast("array<struct<epoch:int,shard:int,partial:boolean>>")),
                    lambda d: ~d.partial | F.coalesce("picked", F.lit(False)))
    return placed.withColumn("draws", held).drop("nr", "block", "blocks", "picked")


def sized_docs(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, source, mark, size`` of every document."""
    narrow = only(docs, doc_id=F.col(id_col).cast("long"), source=F.col(source_col).cast("string"), mark=_mark(id_col, text_col),
                  text=F.col(text_col).cast("string"))
    return settle(word_counts(narrow, "text", "size"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, draws, taken``, a row per document."""
    sized = sized_docs(docs, id_col, text_col, source_col)
    return drawn(sized, plan(sized, **options)).withColumn("taken", F.col("size") * F.size("draws")).drop("mark")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``document`` (a row of ``docs``) as often as the mix draws it, with ``epoch, shard, order``.

    A shard is what has its number, sorted by ``order``.
    """
    mix = plan(sized_docs(docs, id_col, text_col, source_col), **options)
    row = only(docs, document=F.struct(*[F.col(f"`{c}`") for c in docs.columns]), source=F.col(source_col).cast("string"), mark=_mark(id_col, text_col))
    found = drawn(row, mix).select("document", "mark", F.inline("draws"))
    order = F.expr(f"xxhash64({mix.seed + 2}, shard, epoch, mark)")
    return found.select("document", "epoch", "shard", order.alias("order"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix draws them, shard after shard, each in its order."""
    rows = mixed_rows(docs, **options)
    return rows.repartitionByRange(F.col("shard"), F.col("order")).sortWithinPartitions("shard", "order").select("document.*")
