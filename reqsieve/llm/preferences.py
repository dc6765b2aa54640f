"""Quality scores learnt from preferences, after Bradley and Terry (operator 4).

A document's strength is a weighted sum of features of its text. Every training pair is a document with the
better label and one with the worse; the weights minimise the logistic loss on the differences of their
features, so only orderings are learnt. The strengths of the training documents then give the threshold: the
quantile at the share of the worse label. A score is the chance to be preferred to a document at the
threshold, so 0.5 is the threshold itself.

Features come from the whole text of every document, by arrays, and are the only thing that leaves the tasks. The
fit takes all labelled training documents: those of the label with more are dealt to groups, each with some of the other
label, and every one is paired with ``PARTNERS`` of them. Newton's method needs sums over the pairs, which the tasks
add up, a pass over the groups for each step. The threshold is the exact quantile of all strengths, found by counts in
ranges. So the driver holds sums only, of a fixed size for each task.

Defined results: a null text is empty, and an empty text has a score as any other. Labels that are null or neither 0
nor 1 are ignored; a document labelled twice counts twice. A null id has no label and is not held out. If
training has not both labels, every score is 0.5. Repeated rows are each returned. Other columns are ignored, labels and
sources too. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.stored import only, settle
from reqsieve.llm.words import Slice, slices

#: Documents of the label with more that are dealt to a group, and those of the other label that each is paired with.
DEALT, PARTNERS = 512, 64
#: Pairs that ``fit`` draws.
MOST_PAIRS = 200_000
RIDGE = 1e-3
SEED = 7

# Classes of characters whose shares are features.
CLASSES = {"symbol": "#*$%&|<>", "bar": "|", "mark": "!?", "stop": ".,;:", "digit": "0123456789", "quote": "\"'()[]{}"}
_CLASS = {name: np.isin(np.arange(256), [ord(c) for c in chars]) for name, chars in CLASSES.items()}
_CLASS["upper"] = (np.arange(256) >= 0x41) & (np.arange(256) < 0x5B)
_CLASS["letter"] = _CLASS["upper"] | ((np.arange(256) >= 0x61) & (np.arange(256) < 0x7B)) | (np.arange(256) >= 0x80)
FEATURES = [*_CLASS, "log_words", "word_length", "same_words", "same_windows", "next_same", "lines_of_words", "marked_words", "symbol_words"]
#: Each feature is there as it is and with small values spread out.
WIDTH = 2 * len(FEATURES)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def features(part: Slice) -> np.ndarray:
    """A row per text of a slice (of texts as they are)."""
    words, data = part.words(), part.data
    n = np.diff(words.bounds).astype(float)
    size = np.maximum(np.diff(part.bounds), 1).astype(float)
    at_least_one = np.maximum(n, 1)
    columns = [_per_text(table[data], part.bounds) / size for table in _CLASS.values()]
    h = words.hashes()
    lengths = (words.ends - words.starts).astype(float)
    same_words, same_windows = np.zeros(len(part)), np.zeros(len(part))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] if len(h) else h
    for i, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
        if b - a > 1:
            same_words[i] = 1 - len(np.unique(h[a:b])) / (b - a)
            same_windows[i] = 1 - len(np.unique(pairs[a: b - 1])) / (b - a - 1)
    follows = np.zeros(len(h))
    follows[1:] = h[1:] == h[:-1]
    follows[words.bounds[:-1][n > 0]] = 0
    last = data[words.ends - 1]
    columns += [
        np.log1p(n) / 10, _per_text(lengths, words.bounds) / at_least_one / 10, same_words, same_windows, _per_text(follows, words.bounds) / at_least_one,
        _per_text(data == 0x0A, part.bounds) / at_least_one, _per_text(_CLASS["mark"][last], words.bounds) / at_least_one,
        _per_text(_CLASS["symbol"][last], words.bounds) / at_least_one,
    ]
    plain = np.stack(columns, axis=1)
    return np.concatenate([plain, np.log1p(50 * plain) / np.log(51)], axis=1)


def text_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, features``, a row per document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), lower=False):
                found = features(part)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * WIDTH), pa.array(found.ravel()))
                yield pa.record_batch([batch.column(0).slice(part.first, len(part)), lists], ["doc_id", "features"])

    texts = only(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col).cast("string"))
    return texts.mapInArrow(rows, "doc_id long, features array<double>")


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.scale) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.strength(rows) - self.threshold, -30, 30))), 12)


def pair_sums(differences: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Number of pairs, sums of their logistic losses, of the losses' gradients and of the curves, in one array."""
    margins = differences @ weights
    chance = 1 / (1 + np.exp(np.clip(margins, -500, 500)))
    curve = (differences * (chance * (1 - chance))[:, None]).T @ differences
    return np.concatenate(([len(differences), np.logaddexp(0, -margins).sum()], -(differences * chance[:, None]).sum(axis=0), curve.ravel()))


def minimise(sums: Callable[[np.ndarray], np.ndarray], width: int, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    """Weights of least mean loss by Newton's method with halved steps; ``sums`` gives the ``pair_sums`` of all pairs."""
    weights = np.zeros(width)

    def mean(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        n, loss, *rest = sums(w)
        rest = np.array(rest) / n
        return float(loss / n + ridge * (w @ w) / 2), rest[:width] + ridge * w, rest[width:].reshape(width, width) + ridge * np.eye(width)

    now, gradient, curve = mean(weights)
    for _ in range(steps):
        step = np.linalg.solve(curve, gradient)
        while (after := mean(weights - step))[0] > now and np.abs(step).max() > 1e-9:
            step /= 2
        weights, before, (now, gradient, curve) = weights - step, now, (min(now, after[0]), *after[1:])
        if before - now < 1e-9:
            break
    return weights


def fit_pairs(differences: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    """Weights of least mean logistic loss on preferred minus other."""
    return minimise(lambda w: pair_sums(differences, w), differences.shape[1], ridge, steps)


def fit(better: np.ndarray, worse: np.ndarray, share_worse: float, pairs: int = MOST_PAIRS, seed: int = SEED) -> Ranking:
    """From features of documents of both labels in memory, by ``pairs`` drawn pairs; ``fit_all`` is the form for tables."""
    draw = np.random.default_rng(seed)
    both = np.concatenate([better, worse])
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale[scale < 1e-9] = 1.0
    n = min(pairs, len(better) * len(worse))
    left, right = draw.integers(len(better), size=n), draw.integers(len(worse), size=n)
    ranking = Ranking(mean, scale, fit_pairs((better[left] - worse[right]) / scale), 0.0)
    # every document stands for as many as the share of its label says
    strength = np.concatenate([ranking.strength(better), ranking.strength(worse)])
    weight = np.concatenate([np.full(len(better), (1 - share_worse) / len(better)), np.full(len(worse), share_worse / len(worse))])
    order = np.argsort(strength, kind="stable")
    below = int(np.searchsorted(np.cumsum(weight[order]), share_worse * (1 + 1e-9), "right"))
    below = min(max(below, 1), len(order) - 1)
    ranking.threshold = float(strength[order[below - 1: below + 1]].mean())
    return ranking


def _added(table: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of an array over all batches; each task hands over one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = make(batch)
                total = made if total is None else total + made
        if total is not None:
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    return np.sum([r.sums for r in table.mapInArrow(rows, "sums array<double>").collect()], axis=0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, WIDTH)


def dealt(labelled: DataFrame, counts: dict[int, int], size: int = DEALT) -> DataFrame:
    """``many, few``: every document of the label with more, in groups of about ``size``, and some of the other label beside each.

    A document of the other label is in as many groups as it takes for all to have about ``PARTNERS``, in one at least.
    """
    large = max(counts, key=lambda label: (counts[label], label))
    n_few, groups = counts[1 - large], -(-counts[large] // size)
    copies = min(groups, -(-PARTNERS * groups // n_few))
    hashed = F.xxhash64("doc_id")
    many = labelled.where(F.col("label") == large).select(F.pmod(hashed, F.lit(groups)).alias("g"), F.col("features").alias("m"), F.lit(None).cast("array<double>").alias("f"))
    few = labelled.where(F.col("label") == 1 - large).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(
        F.pmod(hashed + F.col("copy"), F.lit(groups)).alias("g"), F.lit(None).cast("array<double>").alias("m"), F.col("features").alias("f"))
    return settle(many.union(few).groupBy("g").agg(F.collect_list("m").alias("many"), F.collect_list("f").alias("few")))


def differences(many: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Each document of a group minus ``PARTNERS`` of the other label, all of which have their turn."""
    many, few = (rows[np.lexsort(rows.T)] for rows in (many, few))
    few = few[np.random.default_rng(SEED).permutation(len(few))]
    each = min(PARTNERS, len(few))
    if not each:
        return np.zeros((0, WIDTH))
    if len(many) * each < len(few):  # fewer places than partners
        each = -(-len(few) // max(1, len(many)))
    turn = np.arange(len(many) * each) % len(few)
    return np.repeat(many, each, axis=0) - few[turn]


def at_ranks(values: DataFrame, rank: int, most: int = 100_000) -> tuple[float, float]:
    """The values (column ``s``) at places ``rank`` and ``rank + 1`` of the ascending order, from 0.

    Counts in ranges narrow down where they are; at most ``most`` values reach the driver.
    """
    n, lo, hi = values.agg(F.count("*"), F.min("s"), F.max("s")).first()
    before, inside = 0, values
    while n > most and lo < hi:
        at = F.least(F.floor((F.col("s") - lo) / ((hi - lo) / 1024)), F.lit(1023))
        bins = inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("at").collect()
        ends = before + np.cumsum([b.n for b in bins])
        first, last = (int(np.searchsorted(ends, r, "right")) for r in (rank, rank + 1))
        if first != last:
            return bins[first].hi, bins[last].lo
        before, n, lo, hi = int(ends[first]) - bins[first].n, bins[first].n, bins[first].lo, bins[first].hi
        inside = values.where(F.col("s").between(lo, hi))
    if lo == hi:
        return lo, hi
    held = sorted(r.s for r in inside.collect())
    return held[rank - before], held[rank - before + 1]


def fit_all(labelled: DataFrame, counts: dict[int, int]) -> Ranking:
    """From all labelled documents (``doc_id, features, label``): sums over tasks only, whatever their number."""
    n = counts[0] + counts[1]
    table = labelled.select("features")
    mean = _added(table, lambda batch: _matrix(batch.column(0)).sum(axis=0)) / n
    scale = np.sqrt(_added(table, lambda batch: ((_matrix(batch.column(0)) - mean) ** 2).sum(axis=0)) / n)
    scale[scale < 1e-9] = 1.0
    groups = dealt(labelled, counts)
    sign = 1 if counts[1] >= counts[0] else -1  # preferred minus other

    def sums(weights: np.ndarray) -> np.ndarray:
        def of(batch: pa.RecordBatch) -> np.ndarray:
            return np.sum([pair_sums(sign * differences(*[_matrix(batch.column(name)[i].values) for name in ("many", "few")]) / scale, weights)
                           for i in range(batch.num_rows)], axis=0)

        return _added(groups, of)

    ranking = Ranking(mean, scale, minimise(sums, WIDTH), 0.0)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(ranking.strength(_matrix(batch.column(0))))], ["s"])

    below = min(max(counts[0], 1), n - 1)
    ranking.threshold = sum(at_ranks(settle(table.mapInArrow(strengths, "s double")), below - 1)) / 2
    return ranking


def held_out(id_col: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def rank(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3,
         fold: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row per document; learns from the labels of the other folds."""
    rows = settle(text_features(docs, id_col, text_col))
    marks = only(labels, doc_id=F.col(id_col).cast("long"), label=F.col(label_col).cast("int")).where("label in (0, 1)").where(~held_out("doc_id", folds, fold))
    labelled = settle(rows.join(marks, "doc_id"))
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    model = fit_all(labelled, counts) if counts.keys() == {0, 1} else None

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, WIDTH)
            score = np.full(len(values), 0.5) if model is None else model.score(values)
            yield pa.record_batch([batch.column(0), pa.array(score)], ["doc_id", "score"])

    out = rows.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
