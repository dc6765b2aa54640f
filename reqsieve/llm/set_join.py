"""Joining documents by the Jaccard similarity of their shingle sets, skipping by set relations (operator 13).

1. Texts become sets of shingle hashes; equal sets are one class, named by a number of its own. A class keeps its
   size and its head: its least hashes, as many as step 2 needs.
2. Lookups. Of two sets that can matter to each other at most D hashes of one are not in the other, so their first e + 1
   common hashes are in both heads of D + e + 1. Without its e most frequent hashes a head still shares one with the
   other's. These D + 1 hashes are looked up; those that no other set has are known to be so, and most sets have no more.
3. Relations. In every list the class with the fewest hashes of its own is the hub (long lists are cut into parts with
   hubs of their own, and these have a hub), and all are compared with it on the full sets. Pairs at the least
   similarity are links. A class within ``RADIUS`` of a hub is its follower; what is no follower leads.
4. Index. Leaders in lists that hold several components are indexed with their full sets, rarest hashes first, by the
   first D + 1. Lists are cut into blocks of classes of like size and like position of the hash, with the least and
   greatest of them as a header. In the list of the first hash that two sets share, all that stands before it differs, and
   what comes after it differs by the difference of its size at least: block pairs whose headers exceed what the
   similarity allows are never opened, and in opened ones the same test leaves out pairs, as do the bits that say where
   a set has an odd number of hashes. The full sets confirm the rest. Large groups come together before: of each crowded
   block and of it with the first block of its like, every class is first compared with two of those that these tests
   leave, so that most of what is linked is one component by the time all pairs of different components are asked for.
5. Derived answers. A confirmed pair of leaders that are no link, but near enough for their followers, gives the
   followers' answers: the common part of a follower and the other leader is the leader's, less the hashes it lost that the
   other has, plus those it gained. Applied to one side and then to the other, this gives all pairs of followers.
6. Components of all links; a document's component is the least id that it reaches.

No list is cut short and no partner is left out: every pair of different sets at the least similarity is a link or lies
in one component already. Hashes of shingles have 64 bits, names of sets 128.

Defined results: documents without words have an empty set and are linked with nothing; rows without an id have no
component and link nothing. A text of fewer words than a shingle is one shingle. Repeated rows are in one class, and each
is returned. Rows with one id and different texts are placed by their texts. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.components import components
from reqsieve.llm.near_copies import least_overlap, odd_bits, shingles
from reqsieve.llm.stored import only, settle
from reqsieve.llm.words import lists, slices

#: Words of a shingle, and the similarity in percent from which two sets are linked.
SHINGLE_WORDS, PERCENT = 5, 80
#: Distance in percent up to which a class follows another one.
RADIUS = 1
#: Least hashes by which the similarity with a hub is estimated, and parts of a list.
SKETCH, PARTS = 32, 64
#: Classes of a block, about, and from how many on its classes are first compared with a few others.
BLOCK, CROWD = 256, 32


def _lookups(n, percent: int):
    """D + 1: hashes of a set of n of which one is in every set that leaders or their followers can link with."""
    least = (n * (percent - 2 * RADIUS) + 99) // 100
    return n - least + 1


def _head(n: int, percent: int) -> int:
    """As many hashes as are looked up, and as many frequent ones that are not."""
    return min(n, max(SKETCH, 2 * _lookups(n, percent)))


SIGNATURE = "doc_id long, n_shingles long, key1 long, key2 long, head array<long>, odd binary"


def _named(batches: Iterator[pa.RecordBatch], width: int, kept) -> Iterator[pa.RecordBatch]:
    """Id, size and name of each text's set, and of its ascending hashes as many as ``kept`` says.

    Of whole sets also their ``odd_bits``.
    """
    for batch in batches:
        for part in slices(batch.column(1)):
            sizes, names, some, odd = [], [], [], []
            for found in shingles(part.words(), width):
                sizes.append(len(found))
                names.append(xxhash.xxh128_digest(found.tobytes()))
                some.append(found if kept is None else found[: kept(len(found))])
                odd.append(odd_bits(found) if kept is None else None)
            name = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            bounds = np.concatenate(([0], np.cumsum([len(s) for s in some])))
            yield pa.record_batch(
                [batch.column(0).slice(part.first, len(part)), pa.array(sizes, pa.int64()), pa.array(name[:, 0].copy()),
                 pa.array(name[:, 1].copy()), lists(np.concatenate(some), bounds), pa.array(odd, pa.binary())],
                ["doc_id", "n_shingles", "key1", "key2", "head", "odd"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))


def _full_sets(texts: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """``node, shingles, odd`` of the wanted classes (``node, least, key1, key2``), from a document of each."""
    found = texts.join(wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(
        lambda batches: _named(batches, width, None), SIGNATURE)
    named = wanted.select("node", F.col("least").alias("doc_id"), "key1", "key2")
    return settle(found.join(named, ["doc_id", "key1", "key2"]).groupBy("node").agg(
        F.first("head").alias("shingles"), F.first("odd").alias("odd")))


def _near(common: Column, na: Column, nb: Column, distance: Column | float) -> Column:
    """Is the Jaccard distance of two sets at most so much? A hair more passes: what is linked is tested in whole numbers."""
    return (na + nb - 2 * common) * (2 - distance) <= (na + nb) * distance + 1e-6 * (na + nb)


def _linked(common: Column, na: Column, nb: Column, percent: int) -> Column:
    return common * 100 >= (na + nb - common) * percent


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """``value, node, n, own``: the lookups of each class that others have too; own: hashes of its head that no other has."""
    held = classes.select(F.explode("head").alias("value"), "node")
    shared = held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    entries = F.array_sort(F.collect_list(F.struct("df", "value")))  # at most as many as a head has
    found = held.join(shared, "value").groupBy("node").agg(entries.alias("e"))
    sizes = classes.select("node", "n", F.size("head").alias("m"))
    own = F.col("m") - F.size("e")
    first = F.greatest(F.lit(0), F.expr(f"n - (n * {percent - 2 * RADIUS} + 99) div 100 + 1") - own).cast("int")
    looked = settle(found.join(sizes, "node").select("node", "n", own.alias("own"), F.explode(F.slice("e", 1, first)).alias("e")).select(
        F.col("e.value").alias("value"), "node", "n", "own"))
    several = looked.groupBy("value").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("value")
    return settle(looked.join(several, "value", "left_semi"))


def _hub_pairs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Each class with the hub of its part of a list, and these with the hub of the list, where they seem similar.

    Pairs that are missed here are found by the index.
    """
    hub = F.min(F.struct("own", "node", "n"))
    held = members.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
    parts = held.groupBy("value", "part").agg(hub.alias("hub"))
    tops = parts.groupBy("value").agg(F.min("hub").alias("top"))
    inner = held.join(parts, ["value", "part"]).select("hub", "node", "n")
    outer = parts.join(tops, "value").select(F.col("top").alias("hub"), F.col("hub.node").alias("node"), F.col("hub.n").alias("n"))
    fits = (F.col("hub.node") != F.col("node")) & (F.least("hub.n", "n") * 100 >= F.greatest("hub.n", "n") * percent)
    pairs = inner.union(outer).where(fits).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.slice("head", 1, SKETCH).alias(f"k{side}")), side)
    union = F.slice(F.array_sort(F.array_union("ka", "kb")), 1, SKETCH)
    hits = F.size(F.array_intersect(F.array_intersect("ka", "kb"), union))
    asked = F.least(F.lit(least_overlap(SKETCH, percent)), F.floor(F.size(union) * percent / 100))
    return pairs.where(hits >= asked).select("a", "b")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with the sizes of both full sets and of their common part."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select(
        *pairs.columns, F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"),
        F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))


def _indexed(leaders: DataFrame, percent: int) -> DataFrame:
    """``value, node, component, n, reach, odd, pos``: the first hashes of each leader, where they can still link something.

    ``pos``: how many hashes of the set come before, in the order of all.
    """
    held = leaders.select(F.explode("shingles").alias("value"), "node", "component")
    shared = held.groupBy("value").agg(F.count("*").alias("df"), (F.min("component") < F.max("component")).alias("joins")).where("df > 1")
    entries = F.array_sort(F.collect_list(F.struct("df", "value", "joins")))  # of one text
    found = held.select("value", "node").join(shared, "value").groupBy("node").agg(entries.alias("e"))
    about = leaders.select("node", "component", "n", "reach", "odd")
    own = F.col("n") - F.size("e")
    first = F.greatest(F.lit(0), F.expr(f"n - (n * {percent - 2 * RADIUS} + 99) div 100 + 1") - own).cast("int")
    cut = found.join(about, "node").select(*about.columns, own.alias("own"), F.posexplode(F.slice("e", 1, first)).alias("at", "e"))
    return cut.where("e.joins").select(F.col("e.value").alias("value"), *about.columns, (F.col("own") + F.col("at")).alias("pos"))


ENTRY = ("node", "component", "n", "pos", "reach", "odd")


def _blocks(entries: DataFrame, percent: int) -> DataFrame:
    """Lists in blocks of about ``BLOCK`` entries of like size and position, with headers."""
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log((percent - 2 * RADIUS) / 100))
    placed = entries.withColumn("band", band).withColumn("place", F.floor(F.col("pos") * 16 / F.col("n")))
    key, salt = ["value", "band", "place"], F.pmod(F.xxhash64("node"), F.lit(PARTS))
    large = placed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("cuts")).where("cuts > 1")
    large = settle(large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))))
    cut = placed.withColumn("salt", salt).join(large, [*key, "salt"], "left").withColumn(
        "cut", F.pmod(F.xxhash64("node", F.lit(1)), F.coalesce("cuts", F.lit(1).cast("long"))))
    rest = F.col("n") - F.col("pos")
    return cut.groupBy(*key, "cut").agg(
        *[F.collect_list(c).alias(c) for c in ENTRY],
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("pos").alias("p0"),
        F.min(rest).alias("r0"), F.max(rest).alias("r1"), F.max("reach").alias("far"),
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("node").alias("least"))


def _few(x: np.ndarray, y: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Of pairs of classes for each class the pair with the partner that has most pairs, and that with the least difference."""
    some = []
    for own, other in ((x, y), (y, x)):
        for order in (np.lexsort((other, -np.bincount(other)[other], own)), np.lexsort((other, differ, own))):
            some.append(order[np.flatnonzero(np.diff(own[order], prepend=-1))])
    return np.unique(np.concatenate(some))


def _block_pairs(blocks: DataFrame, percent: int, few: bool = False) -> DataFrame:
    """``a, b, distance``: pairs in different components that sizes and positions allow.

    ``few``: at most four for each class of a crowded block, in this block and in it and the first of its list and of each like.
    """
    def side(batch: pa.RecordBatch, at: int, i: int) -> list[np.ndarray]:
        *numbers, odd = [batch.column(at + j)[i].values for j in range(len(ENTRY))]
        bits = np.frombuffer(b"".join(odd.to_pylist()), np.uint64).reshape(len(odd), -1)
        return [*[v.to_numpy() for v in numbers], bits]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"a": [], "b": [], "distance": []}
            for i in range(batch.num_rows):
                x, y = side(batch, 0, i), side(batch, len(ENTRY), i)
                (node, comp, n, pos, reach), (node2, comp2, n2, pos2, reach2) = ([v[:, None] for v in x[:5]], [v[None, :] for v in y[:5]])
                distance = (100 - percent) / 100 + reach + reach2
                most = (n + n2) * (distance + 1e-6) / (2 - distance)  # hashes that the sets may differ by
                fit = (comp != comp2) & (pos + pos2 + np.abs((n - pos) - (n2 - pos2)) <= most)  # if this is the first common hash
                fit &= np.minimum(n, n2) >= (1 - distance - 1e-6) * np.maximum(n, n2)
                at = np.nonzero(fit)
                differ = np.bitwise_count(x[5][at[0]] ^ y[5][at[1]]).sum(axis=1)
                near = np.flatnonzero(differ <= most[at])
                if few and len(near):
                    near = near[_few(at[0][near], at[1][near], differ[near])]
                at = at[0][near], at[1][near]
                a, b = x[0][at[0]], y[0][at[1]]
                out["a"].append(np.minimum(a, b))
                out["b"].append(np.maximum(a, b))
                out["distance"].append(distance[at])
            if out["a"]:
                pairs = np.unique(np.rec.fromarrays([np.concatenate(out[k]) for k in out], names="a,b,distance"))
                yield pa.record_batch([pa.array(pairs[k].copy()) for k in out], list(out))

    x, y = blocks.alias("x"), blocks.alias("y")
    ordered = F.struct("x.least", "x.band", "x.place", "x.cut") <= F.struct("y.least", "y.band", "y.place", "y.cut")
    if few:
        x, y = (b.where(F.size("node") >= CROWD) for b in (x, y.where("y.cut = 0")))
        ordered = ordered | (F.col("x.cut") > 0)

    def apart(lo: str, hi: str) -> Column:
        """How far two ranges are from each other."""
        return F.greatest(F.lit(0), F.col(f"x.{lo}") - F.col(f"y.{hi}"), F.col(f"y.{lo}") - F.col(f"x.{hi}"))

    distance = F.lit((100 - percent) / 100 + 1e-6) + F.col("x.far") + F.col("y.far")
    several = (F.col("x.c0") != F.col("y.c0")) | (F.col("x.c1") != F.col("y.c1")) | (F.col("x.c0") != F.col("x.c1"))
    near = (F.col("x.p0") + F.col("y.p0") + apart("r0", "r1")) * (2 - distance) <= (F.col("x.n1") + F.col("y.n1")) * distance
    sizes = (F.col("x.n1") >= (1 - distance) * F.col("y.n0")) & (F.col("y.n1") >= (1 - distance) * F.col("x.n0"))
    open_ = x.join(y, (F.col("x.value") == F.col("y.value")) & ordered & several & near & sizes)
    both = open_.select(*[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in "xy" for c in ENTRY])
    if few:
        alone = blocks.where((F.size("node") >= CROWD) & (F.col("cut") > 0) & (F.col("c0") != F.col("c1")))
        both = both.union(alone.select(*[F.col(c).alias(f"{k}_{c}") for k in "xy" for c in ENTRY]))
    return both.mapInArrow(opened, "a long, b long, distance double").distinct()


def _derived(answers: DataFrame, deltas: DataFrame, sets: DataFrame) -> DataFrame:
    """``y, v, ny, nv, common`` for all that ``u`` leads (itself included), from the answers ``u, v, nv, common``."""
    there = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    lost, gained = (F.size(F.array_intersect(c, "sv")).cast("long") for c in ("removed", "added"))
    return answers.join(deltas, "u").join(there, "v").select("y", "v", "ny", "nv", (F.col("common") - lost + gained).alias("common"))


def _deltas(leading: DataFrame, followers: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, y, ny, added, removed``: what the followers of some leaders (``node``) have more and less than these."""
    some = followers.join(leading.select(F.col("node").alias("a")), "a", "left_semi")
    own, other = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    made = some.join(own, "a").join(other, "b").select(
        F.col("a").alias("u"), F.col("b").alias("y"), F.size("sb").cast("long").alias("ny"),
        F.array_except("sb", "sa").alias("added"), F.array_except("sa", "sb").alias("removed"))
    none = F.array().cast("array<long>")
    itself = sets.join(leading, "node", "left_semi").select(
        F.col("node").alias("u"), F.col("node").alias("y"), F.size("shingles").cast("long").alias("ny"), none.alias("added"), none.alias("removed"))
    return settle(made.union(itself))


def join_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row per row of ``docs``."""
    texts, gap = _texts(docs, id_col, text_col), (100 - percent) / 100
    signed = settle(texts.mapInArrow(lambda batches: _named(batches, width, lambda n: _head(n, percent)), SIGNATURE))
    named = signed.where("doc_id is not null and n_shingles > 0")
    classes = settle(named.groupBy("key1", "key2").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("head").alias("head")
    ).withColumn("node", F.monotonically_increasing_id()))
    names = classes.select("node", "least", "key1", "key2")

    # relations
    members = _lists(classes, percent)
    sets = _full_sets(texts, width, names.join(members.select("node").distinct(), "node", "left_semi"))
    related = _compared(_hub_pairs(members, classes, percent), sets)
    related = settle(related.where(_linked(F.col("common"), F.col("na"), F.col("nb"), percent)))
    linked = settle(components(related))
    close = related.where(_linked(F.col("common"), F.col("na"), F.col("nb"), 100 - RADIUS))
    beside = close.join(close.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    far = (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common")))
    followers = settle(beside.groupBy("b").agg(F.min(F.struct("a", far.alias("far"))).alias("to")).select("b", "to.a", "to.far"))
    reach = followers.groupBy(F.col("a").alias("node")).agg(F.max("far").alias("reach"))

    # index and answers of leaders
    placed = members.select("value", "node", "n").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_lists = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value")
    leading = placed.join(open_lists, "value", "left_semi").select("node", "component", "n").distinct()
    leading = leading.join(followers.select(F.col("b").alias("node")), "node", "left_anti").join(reach, "node", "left")
    leaders = settle(leading.withColumn("reach", F.coalesce("reach", F.lit(0.0))).join(sets, "node"))
    entries = settle(_indexed(leaders, percent))
    blocks = settle(_blocks(entries, percent))
    common, na, nb = F.col("common"), F.col("na"), F.col("nb")
    if not blocks.where((F.size("node") >= CROWD) & (F.col("c0") != F.col("c1"))).isEmpty():
        first = _compared(_block_pairs(blocks, percent, few=True), sets).where(_linked(common, na, nb, percent))
        related = settle(related.select("a", "b").union(first.select("a", "b")))
        linked = settle(components(related))
        entries = entries.drop("component").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        blocks = settle(_blocks(settle(entries), percent))
    answers = settle(_compared(_block_pairs(blocks, percent), sets).where(_near(common, na, nb, F.col("distance"))))
    found = related.select("a", "b").union(answers.where(_linked(common, na, nb, percent)).select("a", "b"))

    # answers of followers
    open_ = answers.where(~_linked(common, na, nb, percent))
    if not open_.isEmpty():
        open_ = settle(open_)
        deltas = _deltas(_nodes(open_), followers, sets)
        there = reach.select(F.col("node").alias("v"), "reach")
        half = _derived(open_.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("nb").alias("nv"), "common"), deltas, sets)
        half = settle(half.join(there, "v", "left").where(
            _near(common, F.col("ny"), F.col("nv"), F.lit(gap) + F.coalesce("reach", F.lit(0.0)))).drop("reach"))
        whole = _derived(half.select(F.col("v").alias("u"), F.col("y").alias("v"), F.col("ny").alias("nv"), "common"), deltas, sets)
        found = found.union(settle(whole.where(_linked(common, F.col("ny"), F.col("nv"), percent)).select(
            F.col("y").alias("a"), F.col("v").alias("b"))))

    return _placed(signed, classes, components(found) if not answers.isEmpty() else linked)


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _placed(signed: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with the least id of their class's component."""
    held = classes.join(found, "node", "left").select("key1", "key2", "least", "component")
    ids = held.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = held.join(ids, "component", "left").select("key1", "key2", F.coalesce("component_id", "least").alias("component_id"))
    there = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    rows = signed.select("doc_id", "n_shingles", "key1", "key2")
    yes = rows.where(there).join(of_class, ["key1", "key2"]).select("doc_id", "n_shingles", "component_id")
    return yes.union(rows.where(~there).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


#: Three-word shingles and 90 percent over the table ``documents``, all pairs that share a shingle compared.
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
    select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * met.n >= 90 * (x.n + y.n - met.n)
), edges as (select a, b from links union all select b, a from links
), reached as (
    select distinct a as doc_id, a as c from edges
    union
    select e.b, r.c from reached r join edges e on e.a = r.doc_id
), least as (select doc_id, min(c) as c from reached group by doc_id)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(l.c, d.doc_id) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join least l on l.doc_id = d.doc_id
"""
