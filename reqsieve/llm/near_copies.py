"""Near-copies by bottom-k sketches of one hash function (operator 7).

1. Every text becomes the set of its shingle hashes; its sketch is the k least of them. Texts with equal
   sets form a class, which gets a number, and only classes go on.
2. Inverted lists of the retained values. Two sets with a similarity of t share at least o retained values
   (o: all but a millionth of such pairs do; for small sets it is exact), so whatever the common order of the
   values is, two sketches of m values share one of their first m - o + 1. The order is by list length, rarest
   first: a passage in very many texts, or the common part of many copies, comes last and is seldom needed.
3. In every list the member with the fewest values of its own, and the most shared ones, is the hub, which is sent to the parts that a
   list is cut into. The estimate from the union sketch filters the pairs of hubs and members, and the exact
   similarity of the full sets confirms them. So a list makes as many pairs as it has members, however long it is.
4. What the hubs have linked is one component. Lists that still hold several are searched exactly: the full
   sets of their members, shingles rarest first, meet in the first n - tn + 1 of them, if their positions, and the
   bits that say where a set has an odd number of shingles, allow the overlap that t asks for; the exact similarity
   confirms. No list is cut, no partner is capped.
5. Components of all links; a document's component is the least id it reaches.

Hashes of shingles have 64 bits, names of sets 128.

Defined results: documents without words, and rows without an id, have no links; rows without an id have
no component and are kept. Repeated rows are in one class and each is returned. Rows with one id and
different texts are placed by their texts; ``keep_one`` keeps a row of that id for each of its sets that is the first of
its group. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.components import components
from reqsieve.llm.stored import only, settle
from reqsieve.llm.words import Words, lists, mix, signed, slices

#: Retained values of a sketch.
RETAINED = 32
#: Parts of a list; parts of all hashes, a power of two.
PARTS, ODD_BITS = 64, 512
#: Words of a shingle, and the similarity in percent from which two sets are linked.
SHINGLE_WORDS, PERCENT = 5, 80
#: Share of pairs at the least similarity that may have fewer values in common than is asked for.
MISSED = 1e-6

#: Text bytes that are turned into arrays at a time.
SLICE = 400_000

_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: Words, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes in ascending order (as signed integers).

    A text of fewer words is one shingle; a text without words has none.
    """
    h = words.hashes()
    rolled = h.copy()
    for i in range(1, width):
        rolled[: max(0, len(h) - i)] = mix(rolled[: max(0, len(h) - i)] * _FACTOR + h[i:])
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= width:
            yield np.unique(signed(rolled[a: b - width + 1]))
        elif b > a:
            short = h[a: a + 1]
            for i in range(a + 1, b):
                short = mix(short * _FACTOR + h[i: i + 1])
            yield signed(mix(short + np.uint64(b - a)))
        else:
            yield np.zeros(0, np.int64)


def odd_bits(hashes: np.ndarray) -> bytes:
    """Of each of ``ODD_BITS`` parts of all hashes, does the set have an odd number? Sets differ by a hash at least where this does."""
    return np.packbits(np.bincount(hashes & (ODD_BITS - 1), minlength=ODD_BITS) & 1).tobytes()


SIGNATURE = "doc_id long, n_shingles long, key1 long, key2 long, sketch array<long>, tag1 long, tag2 long"


def _tags(text_col: str) -> dict[str, Column]:
    """Two words that stand for a text."""
    text = F.col(f"`{text_col}`").cast("string")
    return {"tag1": F.xxhash64(text), "tag2": F.xxhash64(F.lit(1), text)}


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, retained: int) -> DataFrame:
    """One row per document: size and name of its set, its sketch, and what stands for its text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), SLICE):
                sizes, names, kept = [], [], []
                for found in shingles(part.words(), width):
                    sizes.append(len(found))
                    names.append(xxhash.xxh128_digest(found.tobytes()))
                    kept.append(found[:retained])
                name = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
                bounds = np.concatenate(([0], np.cumsum([len(k) for k in kept])))
                yield pa.record_batch(
                    [batch.column(0).slice(part.first, len(part)), pa.array(sizes, pa.int64()), pa.array(name[:, 0].copy()),
                     pa.array(name[:, 1].copy()), lists(np.concatenate(kept), bounds),
                     *[batch.column(i).slice(part.first, len(part)) for i in (2, 3)]],
                    ["doc_id", "n_shingles", "key1", "key2", "sketch", "tag1", "tag2"])

    texts = only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"), **_tags(text_col))
    return texts.mapInArrow(rows, SIGNATURE)


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """``node, shingles, odd`` of the wanted classes (``node``, and ``least, tag1, tag2`` of a document of each)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), SLICE):
                found = list(shingles(part.words(), width))
                bounds = np.concatenate(([0], np.cumsum([len(f) for f in found])))
                odd = np.frombuffer(b"".join(map(odd_bits, found)), np.int64)
                yield pa.record_batch([batch.column(0).slice(part.first, len(part)), lists(np.concatenate(found), bounds),
                                       lists(odd, np.arange(len(found) + 1) * (ODD_BITS // 64))], ["node", "shingles", "odd"])

    place = ["least", "tag1", "tag2"]
    texts = only(docs, least=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"), **_tags(text_col))
    found = texts.join(wanted.select("node", *place), place).dropDuplicates(place)  # repeated rows
    return found.select("node", "text").mapInArrow(rows, "node long, shingles array<long>, odd array<long>")


def least_overlap(k: int, percent: int, missed: float = MISSED) -> int:
    """The most o for which k draws, each a hit with the given chance, are fewer than o hits so seldom."""
    t, total = percent / 100, 0.0
    for o in range(k + 1):
        total += math.comb(k, o) * t**o * (1 - t) ** (k - o)
        if total > missed:
            return o
    return k


def _at_least(n: Column, percent: int) -> Column:
    """ceil(n * percent / 100) in whole numbers."""
    return ((n * percent + 99) / 100).cast("long")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    similar = both * 100 >= (F.size("sa") + F.size("sb") - both) * percent
    return settle(pairs.join(left, "a").join(right, "b").where(similar).select("a", "b").distinct())


def _rare_first(classes: DataFrame, retained: int, percent: int) -> DataFrame:
    """``value, node, n, rank``: the first retained values of each class that others have too.

    rank: the values that no other class has, then how many others the rest is shared with; the least one is nearest to all.
    """
    held = classes.select("node", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    shared = held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    least = F.least(_at_least(F.col("n"), percent), F.lit(least_overlap(retained, percent)))
    values = F.array_sort(F.collect_list(F.struct("df", "value")))  # at most as many as a sketch retains
    found = held.join(shared, "value").groupBy("node", "n", "m").agg(values.alias("values"))
    return found.withColumn("first", (F.size("values") - least + 1).cast("int")).where("first > 0").select(
        F.explode(F.slice("values", 1, F.col("first"))).alias("v"), "node", "n",
        F.struct((F.col("m") - F.size("values")).alias("own"), F.aggregate("values", F.lit(0).cast("long"), lambda s, v: s - v["df"]).alias("less")).alias("rank")
    ).select("v.value", "node", "n", "rank")


def _hub_pairs(lists_: DataFrame, classes: DataFrame, retained: int, percent: int) -> DataFrame:
    """Each list's hub with its members, where the union sketch says they may be similar enough.

    The hub goes to every part of its list, so no task meets a whole one.
    """
    hub = F.min(F.struct("rank", "node", "n")).alias("hub")
    held = lists_.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
    parts = held.groupBy("value", "part").agg(hub)
    hubs = parts.select("value", "part").join(parts.groupBy("value").agg(F.min("hub").alias("hub")), "value")
    pairs = held.join(hubs, ["value", "part"]).where((F.col("node") != F.col("hub.node")) & _sizes_fit(F.col("n"), F.col("hub.n"), percent))
    pairs = pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    sketches = classes.select("node", "sketch")
    union = F.slice(F.array_sort(F.array_union("ka", "kb")), 1, retained)
    hits = F.size(F.array_intersect(F.array_intersect("ka", "kb"), union))
    asked = F.when(F.size(union) < retained, _at_least(F.size(union), percent)).otherwise(least_overlap(retained, percent))
    left, right = (sketches.select(F.col("node").alias(n), F.col("sketch").alias(f"k{n}")) for n in "ab")
    return pairs.join(left, "a").join(right, "b").where(hits >= asked).select("a", "b")


def _exact_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``node, component`` rows in different components whose full sets may be similar enough."""
    held = members.join(sets, "node").select("node", "component", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s"))
    shared = held.groupBy("s").agg(
        F.count("*").alias("df"), (F.min("component") < F.max("component")).alias("joins")).where("df > 1")
    values = F.array_sort(F.collect_list(F.struct("df", "s", "joins")))  # of one document
    found = held.join(shared, "s").groupBy("node", "component", "n").agg(values.alias("values"))
    own = F.col("n") - F.size("values")
    first = F.greatest(F.lit(0), F.col("n") - _at_least(F.col("n"), percent) + 1 - own).cast("int")
    keys = found.select("node", "component", "n", own.alias("own"), F.posexplode(F.slice("values", 1, first))).where("col.joins").select(
        F.col("col.s").alias("s"), "node", "component", "n", (F.col("n") - F.col("own") - F.col("pos")).alias("rest"))
    keys = keys.join(sets.select("node", "odd"), "node")
    a, b = keys.alias("a"), keys.alias("b")
    asked = F.ceil((F.col("a.n") + F.col("b.n")) * percent / (100 + percent) - 1e-6)
    differ = reduce(add, [F.bit_count(F.col("a.odd")[i].bitwiseXOR(F.col("b.odd")[i])) for i in range(ODD_BITS // 64)])
    met = (
        (F.col("a.s") == F.col("b.s")) & (F.col("a.component") < F.col("b.component"))
        & _sizes_fit(F.col("a.n"), F.col("b.n"), percent) & (F.least("a.rest", "b.rest") >= asked)
        & (differ <= F.col("a.n") + F.col("b.n") - 2 * asked)
    )
    return a.join(b, met).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def _placed(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, retained: int) -> DataFrame:
    """The signatures of all documents with their ``component_id``."""
    signed_docs = settle(signatures(docs, id_col, text_col, width, retained))
    named = signed_docs.where("doc_id is not null and n_shingles > 0")
    classes = settle(named.groupBy("key1", "key2").agg(
        F.min(F.struct("doc_id", "tag1", "tag2")).alias("of"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    ).select("key1", "key2", F.col("of.doc_id").alias("least"), "of.tag1", "of.tag2", "n", "sketch", F.monotonically_increasing_id().alias("node")))

    prefixes = settle(_rare_first(classes, retained, percent))
    several = prefixes.groupBy("value").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("value")
    members = settle(prefixes.join(several, "value", "left_semi"))
    wanted = classes.select("node", "least", "tag1", "tag2").join(members.select("node").distinct(), "node", "left_semi")
    sets = settle(full_sets(docs, id_col, text_col, width, wanted))

    links = _confirmed(_hub_pairs(members, classes, retained, percent), sets, percent)
    linked = settle(components(links))
    placed = members.select("value", "node").join(linked, "node", "left").select(
        "value", "node", F.coalesce("component", "node").alias("component"))
    unsettled = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value")
    rest = settle(placed.join(unsettled, "value", "left_semi").select("node", "component").distinct())
    more = _confirmed(_exact_pairs(rest, sets, percent), sets, percent)

    found = components(links.union(more)) if not more.isEmpty() else linked
    held = classes.join(found, "node", "left").select("key1", "key2", "least", "component")
    ids = held.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = held.join(ids, "component", "left").select("key1", "key2", F.coalesce("component_id", "least").alias("component_id"))
    there = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    rows = signed_docs.drop("sketch")
    yes = rows.where(there).join(of_class, ["key1", "key2"]).select(*rows.columns, "component_id")
    return yes.union(rows.where(~there).withColumn("component_id", F.col("doc_id")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS,
                percent: int = PERCENT, retained: int = RETAINED) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row per row of ``docs``."""
    return _placed(docs, id_col, text_col, width, percent, retained).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS,
             percent: int = PERCENT, retained: int = RETAINED) -> DataFrame:
    """The documents of which ``near_copies`` keeps one per group, and all without an id.

    Of rows with one id and one set, one stays: a text of which there are several sets under that id gives one for each.
    """
    from pyspark.sql import Window

    kept = _placed(docs, id_col, text_col, width, percent, retained).where("doc_id = component_id")
    kept = kept.groupBy("doc_id", "key1", "key2").agg(F.min(F.struct("tag1", "tag2")).alias("tag")).select(
        F.col("doc_id").alias("__id"), F.col("tag.tag1").alias("__tag1"), F.col("tag.tag2").alias("__tag2")).distinct()
    tags = _tags(text_col)
    mark, hashable = ["__id", "__tag1", "__tag2"], [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    found = docs.withColumns({"__id": F.col(f"`{id_col}`").cast("long"), "__tag1": tags["tag1"], "__tag2": tags["tag2"]})
    first = F.row_number().over(Window.partitionBy(*mark).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in hashable])))
    named = found.join(kept, mark, "left_semi").withColumn("__nr", first).where("__nr = 1")
    return named.drop(*mark, "__nr").union(docs.where(F.col(f"`{id_col}`").isNull()))


#: Three-word shingles and 85 percent over the table ``documents``, all pairs that share a shingle compared.
ORACLE = r"""
with recursive texts as (
    select doc_id, trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from documents
), words as (
    select doc_id, case when t = '' then [] else regexp_split_to_array(t, '[\x20\x09-\x0D]+') end as w from texts
), shingles as (
    select distinct doc_id, unnest(case
        when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id
), met as (
    select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
    select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * met.n >= 85 * (x.n + y.n - met.n)
), edges as (select a, b from links union all select b, a from links
), reached as (
    select distinct a as doc_id, a as c from edges
    union
    select e.b, r.c from reached r join edges e on e.a = r.doc_id
), least as (select doc_id, min(c) as c from reached group by doc_id)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(l.c, d.doc_id) as component_id, coalesce(l.c, d.doc_id) = d.doc_id as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join least l on l.doc_id = d.doc_id
"""
