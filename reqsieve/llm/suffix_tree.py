"""Language-model scores from a probabilistic suffix tree (operator 3).

The tree predicts the next byte of a text from the longest of its contexts that ends there. Texts are
lower-cased, their words joined by single spaces, and closed by an end symbol that is also the context
of a text's first byte, so the score is the probability of the text's tokens. Contexts have up to
``DEPTH`` bytes; every context that occurs is kept if what follows it diverges from what follows its suffix by
``LEAST_DIVERGENCE`` nats, however rare it is. (``share`` asks for a smaller model: contexts that a lesser
share of all positions follows are not kept; by default there is none.) Distributions are smoothed with
that of the longest kept suffix, the root's with a uniform one.

Counting: every task counts the byte sequences and words of its documents with arrays and hands over sums;
Spark adds them up. All documents are counted. Scoring: the contexts are a table. The most frequent ones, at most
``MOST_CONTEXTS`` and with each all its parts, become transitions that are broadcast, and a task follows thousands of
stretches of text through them at once, each begun ``DEPTH`` bytes early, which is enough to know the state. Where
the state is as long as a context can be, its cost is the model's. At the other positions rarer contexts may change
it: what these add is joined with the table, for each different byte sequence once. That of at most ``MOST_GRAMS``
frequent sequences is broadcast too, the others meet the documents in a join, as the words do: at most ``HEAD_WORDS``
of them, by their share of all tokens, are broadcast, counts of others are joined. All keys of these joins are rare.

The base score is that of the word counts: words ``[^\\x20\\x09-\\x0D]+`` and one end per text.
Words are told apart by 64-bit hashes.

Defined results: a null or blank text is its end alone. A null id is a training row. Repeated rows are
counted and scored as often as they occur. An empty table gives no rows; without training rows all
is uniform. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.stored import only, settle
from reqsieve.llm.words import Words, hash_word, lists, signed, slices

DEPTH = 5
LEAST_DIVERGENCE = 0.01
#: Contexts that are broadcast as transitions, and byte sequences whose costs are; all others are joined.
MOST_CONTEXTS, MOST_GRAMS = 60_000, 1_000_000
#: Weight of the suffix's distribution, in observations for each symbol that follows the context.
SMOOTHING = 2.0
#: Words with at least this share of all tokens are looked up in a broadcast table.
HEAD_WORDS = 20_000

# Bytes that no UTF-8 text has.
END, NOTHING = 0xFF, 0xFE
END_TOKEN = hash_word(b"\n") - (1 << 64 if hash_word(b"\n") >= 1 << 63 else 0)
SYMBOLS = 257
WORD, GRAM = 0, 1
#: Distinct counts that a task gathers before it hands them over.
GATHERED = 1_000_000


def sequence(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a slice as one byte sequence, each closed by END, and where each begins."""
    sizes = words.ends - words.starts
    per_text = np.diff(words.bounds)
    lengths = np.concatenate(([0], np.cumsum(sizes + 1)))
    spans = np.maximum(lengths[words.bounds[1:]] - lengths[words.bounds[:-1]], 1)
    begins = np.concatenate(([0], np.cumsum(spans)))
    out = np.full(begins[-1], 0x20, np.uint8)
    blank_before = np.concatenate(([0], np.cumsum(per_text == 0)))[:-1]
    word_at = lengths[:-1] + np.repeat(blank_before, per_text)
    bytes_before = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    out[np.repeat(word_at - bytes_before, sizes) + np.arange(sizes.sum())] = words.of.data[words.inside]
    out[begins[1:] - 1] = END
    return out, begins


def within(begins: np.ndarray) -> np.ndarray:
    """How many bytes of its text come before each position."""
    return np.arange(begins[-1]) - np.repeat(begins[:-1], np.diff(begins))


def grams(data: np.ndarray, begins: np.ndarray, depth: int, some: np.ndarray | slice = slice(None)) -> np.ndarray:
    """For (some) positions the ``depth`` bytes before each and its own, the latest lowest. Before a text is its END, before that NOTHING."""
    out = data[some].astype(np.uint64)
    at, place = within(begins)[some], np.arange(len(data))[some]
    for back in range(1, depth + 1):
        older = np.full(len(out), NOTHING, np.uint64)
        inside = at >= back
        older[inside] = data[place[inside] - back]
        older[at == back - 1] = END
        out |= older << np.uint64(8 * back)
    return out


class _Sums:
    """Counts by key, kept as sorted arrays."""

    def __init__(self):
        self.keys, self.sums, self.waiting, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, values: np.ndarray) -> None:
        keys, sums = np.unique(values, return_counts=True)
        self.waiting.append((keys, sums))
        self.size += len(keys)
        if self.size > max(GATHERED // 2, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        sums = np.concatenate([self.sums, *[s for _, s in self.waiting]])
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], sums[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        self.keys, self.sums = keys[first], np.add.reduceat(sums, first) if len(first) else sums
        self.waiting, self.size = [], 0

    def take(self, kind: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        for a in range(0, len(self.keys), 1 << 17):
            keys = signed(self.keys[a: a + (1 << 17)])
            yield pa.record_batch([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(self.sums[a: a + (1 << 17)])],
                                  ["kind", "key", "n"])
        self.__init__()


def counts(texts: DataFrame, depth: int) -> DataFrame:
    """``kind, key, n``: how often each word and each byte sequence occurs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ends = {WORD: _Sums(), GRAM: _Sums()}, 0
        for batch in batches:
            for part in slices(batch.column(0)):
                words = part.words()
                ends += len(part)
                found[WORD].add(words.hashes())
                found[GRAM].add(grams(*sequence(words), depth))
                for kind, sums in found.items():
                    if len(sums.keys) > GATHERED:
                        yield from sums.take(kind)
        for kind, sums in found.items():
            yield from sums.take(kind)
        if ends:
            yield pa.record_batch([pa.array([WORD], pa.int32()), pa.array([END_TOKEN], pa.int64()), pa.array([ends], pa.int64())],
                                  ["kind", "key", "n"])

    return texts.mapInArrow(rows, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def most_frequent(df: DataFrame, n: str, most: int) -> Column:
    """Is a row one of at most ``most`` with the greatest counts? Rows of one count, about, are all in or all out."""
    about = F.floor(F.log2(F.col(n).cast("double")) * 16)
    least, held = 1 << 20, 0
    for size, rows in sorted(df.groupBy(about).agg(F.count("*")).collect(), reverse=True):  # sixteen sizes for each bit of a long
        held += rows
        if held > most:
            break
        least = size
    return about >= least


def contexts(sequences: DataFrame, depth: int, share: float, divergence: float) -> DataFrame:
    """``d, context, total, next, kept``: every context, what follows it how often, and whether the model has it.

    ``d``: bytes of the context; the root has none.
    """
    total = sequences.agg(F.sum("n")).first()[0] or 0
    at_depth = sequences.select(F.col("key"), "n", F.explode(F.lit(list(range(depth + 1)))).alias("d")).select(
        "d", F.col("key").bitwiseAND(255).cast("int").alias("x"), "n", _context())
    known = (F.col("d") == 0) | (F.expr("shiftright(context, 8 * (d - 1)) & 255") != NOTHING)
    followers = at_depth.where(known).groupBy("d", "context", "x").agg(F.sum("n").alias("n"))
    next_ = F.collect_list(F.struct("x", "n")).alias("next")  # of a context at most one entry per symbol
    found = settle(followers.groupBy("d", "context").agg(F.sum("n").alias("total"), next_))
    each = found.select("d", "context", "total", F.inline("next"))
    suffix = each.select((F.col("d") + 1).alias("d"), F.col("context").alias("suffix"), "x",
                         F.col("total").alias("suffix_total"), F.col("n").alias("suffix_n"))
    own = each.where("d > 0").withColumn("suffix", F.expr("context & (shiftleft(1L, 8 * (d - 1)) - 1)"))
    p, q = F.col("n") / F.col("total"), F.col("suffix_n") / F.col("suffix_total")
    judged = own.join(suffix, ["d", "suffix", "x"]).groupBy("d", "context", "total").agg(
        next_, F.sum(p * F.log(p / q)).alias("divergence"))
    kept = (F.col("divergence") >= divergence) & (F.col("total") >= share * total)
    return settle(judged.select("d", "context", "total", "next", kept.alias("kept")).union(
        found.where("d = 0").select("d", "context", "total", "next", F.lit(True))))


def _context() -> Column:
    """The ``d`` bytes before the last one of a ``key``."""
    return F.expr("shiftright(key, 8) & (shiftleft(1L, 8 * d) - 1)").alias("context")


Head = list[tuple[bytes, bool, np.ndarray, np.ndarray]]


def frequent(found: DataFrame) -> Head:
    """Contexts (oldest byte first), whether each is kept, what follows it, and how often; shorter ones first."""
    rows = found.select("d", "context", "kept", F.col("next.x").alias("xs"), F.col("next.n").alias("ns")).toArrow()
    out = []
    for d, context, kept, xs, ns in zip(*rows.columns):
        name = context.as_py().to_bytes(8, "big")[8 - d.as_py():] if d.as_py() else b""
        out.append((name, kept.as_py(), xs.values.to_numpy(), ns.values.to_numpy()))
    return sorted(out, key=lambda c: (len(c[0]), c[0])) or [(b"", True, np.zeros(0, np.int64), np.zeros(0, np.int64))]


@dataclass
class Tree:
    """Frequent contexts as an automaton: ``move[state, symbol]`` and ``cost[row[state], symbol]`` (log10)."""

    depth: int
    symbol: np.ndarray   # byte -> symbol; bytes never seen are the last symbol
    move: np.ndarray
    cost: np.ndarray
    row: np.ndarray
    length: np.ndarray   # bytes of each state
    start: int

    def costs(self, data: np.ndarray, stretches: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each byte of a sequence, and how long its longest frequent context is."""
        symbols = self.symbol[data].astype(np.int64)
        step = max(64, -(-len(data) // stretches))
        n = -(-len(data) // step)
        width = self.move.shape[1]
        state = np.zeros(n, np.int64)
        padded = np.concatenate((np.zeros(self.depth, np.int64), symbols, np.zeros(n * step - len(data), np.int64)))
        move, cost, row = self.move.ravel(), self.cost.ravel(), self.row
        base = np.arange(n) * step
        for t in range(self.depth):  # brings every stretch but the first to its state
            state = move[state * width + padded[base + t]]
        state[:1] = self.start
        out, long = np.empty((step, n)), np.empty((step, n), np.uint8)
        for t in range(step):
            x = padded[base + self.depth + t]
            out[t], long[t] = cost[row[state] * width + x], self.length[state]
            state = move[state * width + x]
        return out.T.reshape(-1)[: len(data)], long.T.reshape(-1)[: len(data)]

    def open_sequences(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Which byte sequences (``grams``) have longer contexts than the frequent ones; of these the cost, and both lengths."""
        state, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for back in range(self.depth, 0, -1):
            x = keys >> np.uint64(8 * back) & np.uint64(255)
            known += x != NOTHING
            state = np.where(x == NOTHING, 0, self.move[state, self.symbol[x]])
        some = np.flatnonzero(self.length[state] < known)
        cost = self.cost[self.row[state[some]], self.symbol[keys[some] & np.uint64(255)]]
        return some, cost.astype(np.float64), self.length[state[some]], known[some]


def tree(head: Head, depth: int, smoothing: float = SMOOTHING) -> Tree:
    """A context's parts are at least as frequent as it is, so the contexts are the states, and the next one follows from the state alone."""
    seen = sorted({END}.union(*[xs.tolist() for _, _, xs, _ in head]))
    number = {x: i for i, x in enumerate(seen)}
    width = len(seen) + 1
    symbol = np.full(256, width - 1, np.int32)
    symbol[seen] = np.arange(len(seen))

    states = [context for context, *_ in head]
    at = {s: i for i, s in enumerate(states)}
    longer: dict[bytes, list[bytes]] = {}
    for s in states[1:]:
        longer.setdefault(s[:-1], []).append(s)
    move = np.zeros((len(states), width), np.int32)
    row = np.zeros(len(states), np.int32)
    chance = np.empty((sum(kept for _, kept, *_ in head), width))
    made = 0
    for i, (context, kept, xs, ns) in enumerate(head):  # shorter ones first
        suffix = at[context[1:]]
        move[i] = move[suffix]
        for s in longer.get(context, ()):
            move[i, number[s[-1]]] = at[s]
        row[i] = row[suffix]
        if kept:
            before = chance[row[suffix]] if context else np.full(width, 1 / SYMBOLS)
            n = np.zeros(width)
            n[symbol[xs]] = ns
            weight = smoothing * max(1, len(xs))
            chance[made] = (n + weight * before) / (n.sum() + weight)
            row[i], made = made, made + 1
    length = np.array([len(s) for s in states], np.uint8)
    return Tree(depth, symbol, move, np.log10(chance).astype(np.float32), row, length, at.get(bytes([END]), 0))


def open_sequences(sequences: DataFrame, model: Broadcast) -> DataFrame:
    """``key, n, cost, long, known`` of the sequences (``key, n``) on which contexts outside the tree may bear."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, cost, long, known = model.value.open_sequences(batch.column(0).to_numpy().view(np.uint64))
            yield pa.record_batch([batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), pa.array(cost),
                                   pa.array(long.astype(np.int32)), pa.array(known.astype(np.int32))], ["key", "n", "cost", "long", "known"])

    return sequences.select("key", "n").mapInArrow(rows, "key long, n long, cost double, long int, known int")


def added(sequences: DataFrame, rare: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """``key, more``: what the ``rare`` contexts (``d, context, total, next``) add to the cost of each of the ``open_sequences``."""
    asked = sequences.select("key", "cost", F.col("key").bitwiseAND(255).alias("x"),
                             F.explode(F.sequence(F.col("long") + 1, F.col("known"))).alias("d")).withColumn("context", _context())
    n = F.expr("aggregate(next, 0L, (s, e) -> s + if(e.x = x, e.n, 0L))")
    level = F.struct("d", n.alias("n"), "total", (F.lit(float(smoothing)) * F.size("next")).alias("weight"))
    levels = F.array_sort(F.collect_list(F.when(F.col("total").isNotNull(), level)))  # at most one for each byte of the context
    chance = F.aggregate("levels", F.pow(F.lit(10.0), "cost"), lambda p, e: (e.n + e.weight * p) / (e.total + e.weight))
    return asked.join(rare, ["d", "context"], "left").groupBy("key", "cost").agg(levels.alias("levels")).select(
        "key", (F.log10(chance) - F.col("cost")).alias("more"))


def held_out(id_col: str, folds: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def _scores(model: Tree, partial: bool, near: np.ndarray, near_more: np.ndarray, data: np.ndarray,
            begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each text's score by the tree and the ``near`` sequences; the other open sequences of each, how often, and their bounds."""
    costs, long = model.costs(data)
    open_ = np.flatnonzero(long < np.minimum(model.depth, within(begins) + 1)) if partial else np.zeros(0, np.int64)
    keys = signed(grams(data, begins, model.depth, open_))
    place = np.searchsorted(near, keys)
    place[place == len(near)] = 0
    there = near[place] == keys if len(near) else np.zeros(len(keys), bool)
    costs[open_[there]] += near_more[place[there]]
    keys, text = keys[~there], np.searchsorted(begins, open_[~there], "right") - 1
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]))))
    occur = np.diff(np.concatenate((first, [len(keys)])))
    scores = np.add.reduceat(costs, begins[:-1]) if len(data) else np.zeros(0)
    return scores, keys[first], occur, np.searchsorted(text[first], np.arange(len(begins)))


SCORED = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
          "words array<long>, times array<int>, sequences array<long>, occur array<int>")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, depth: int = DEPTH,
          share: float = 0.0, divergence: float = LEAST_DIVERGENCE, most: int = MOST_CONTEXTS,
          head_words: int = HEAD_WORDS, most_grams: int = MOST_GRAMS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row per document.

    Learns from the documents whose crc32 of the id is not divisible by ``folds``. ``most``, ``head_words`` and
    ``most_grams`` say what is broadcast and what is joined; they change no score.
    """
    context = docs.sparkSession.sparkContext
    texts = only(docs, doc_id=F.col(id_col).cast("long"), held_out=held_out(id_col, folds), text=F.col(text_col).cast("string"))
    counted = settle(counts(texts.where("not held_out").select("text"), depth))
    words = counted.where(F.col("kind") == WORD).select("key", "n")
    said = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, rest = int(said.n), np.log10(int(said.n) + 0.1 * (int(said.v) + 1))
    heads = sorted((r.key, r.n) for r in words.where((F.col("n") >= n_train / head_words) & (F.col("n") > 0)).collect())
    sequences = counted.where(F.col("kind") == GRAM).select("key", "n")
    found = contexts(sequences, depth, share, divergence)
    head = (F.col("d") == 0) | most_frequent(found.where("d > 0"), "total", most)
    model = context.broadcast(tree(frequent(found.where(head)), depth))
    rare = found.where(~head & F.col("kept")).drop("kept")
    partial = not rare.isEmpty()
    near, near_more = np.zeros(0, np.int64), np.zeros(0)
    if partial:
        open_ = settle(open_sequences(sequences, model))
        costs = added(open_.where(most_frequent(open_, "n", most_grams)), rare).toArrow()  # at most ``most_grams``
        near, near_more = (costs.column(c).to_numpy() for c in ("key", "more"))
        order = np.argsort(near)
        near, near_more = near[order], near_more[order]
    ends = next((n for k, n in heads if k == END_TOKEN), None)
    if ends is None:
        ends = (words.where(F.col("key") == END_TOKEN).first() or [0, 0])[1]
    shared = context.broadcast((np.array([k for k, _ in heads], np.int64), np.array([n for _, n in heads], np.float64), near, near_more))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_, (head, head_n, near, near_more) = model.value, shared.value
        head_log = np.log10(head_n + 0.1)
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch.column(2)):
                found = part.words()
                hashes, bounds = signed(found.hashes()), found.bounds.tolist()
                scores, keys, occur, at_key = _scores(tree_, partial, near, near_more, *sequence(found))
                known, base, rare, times, cuts = [], [], [], [], [0]
                for a, b in zip(bounds[:-1], bounds[1:]):
                    distinct, n = np.unique(hashes[a:b], return_counts=True)
                    place = np.searchsorted(head, distinct)
                    place[place == len(head)] = 0
                    common = head[place] == distinct if len(head) else np.zeros(len(distinct), bool)
                    known.append(int(n[common].sum()))
                    base.append(float((head_log[place[common]] * n[common]).sum()))
                    rare.append(distinct[~common])
                    times.append(n[~common])
                    cuts.append(cuts[-1] + len(rare[-1]))
                size, cuts = len(part), np.array(cuts)
                yield pa.record_batch([
                    pa.array(np.arange(at, at + size)), batch.column(0).slice(part.first, size), batch.column(1).slice(part.first, size),
                    pa.array(np.diff(found.bounds) + 1), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores),
                    lists(np.concatenate(rare), cuts), lists(np.concatenate(times).astype(np.int32), cuts),
                    lists(keys, at_key), lists(occur.astype(np.int32), at_key),
                ], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times", "sequences", "occur"])
                at += size

    scored = settle(texts.mapInArrow(rows, SCORED))
    each = scored.select("row", F.inline(F.arrays_zip("words", "times")))
    c = F.coalesce("n", F.lit(0))
    sums = each.join(words, each.words == words.key, "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c + 0.1)).alias("rare_base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    end_base = float(np.log10(ends + 0.1))
    told = scored.drop("words", "times", "sequences", "occur").join(sums, "row", "left").withColumn("more", F.lit(0.0))
    if partial:
        each = scored.select("row", F.inline(F.arrays_zip(F.col("sequences").alias("key"), "occur")))
        asked = open_sequences(each.groupBy("key").agg(F.sum("occur").alias("n")), model)
        more = each.join(added(asked, rare), "key").groupBy("row").agg(F.sum(F.col("occur") * F.col("more")).alias("more"))
        told = told.drop("more").join(more, "row", "left")
    return told.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end_base - F.col("n_tokens") * float(rest)).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
