"""Passages that repeat across documents, by windows of three lines (operator 5). DataFrame functions only.

A line counts by its lower-cased text without spaces around it; blank lines are left out of windows. Every three
consecutive lines make a window, two 64-bit hashes of them its name. The first occurrence of a window (by
document id, then by position) stays; the lines of all later ones are removed. Occurrences overlap, so the
removed lines of a document are the union of the positions that they cover; of an occurrence that overlaps the
first one of the same window in the same document, only the lines after it.

Windows are counted with partial sums before the shuffle; only windows that repeat go on, as narrow rows. Their
occurrences meet the one row of their window, so a passage in a third of all documents is a key of a join
that Spark splits, never a group. Texts are shuffled once, by document.

Defined results: null ids come last, in the order of a hash of their texts. Repeated rows (equal ids and texts) are
one document and keep the same lines. A null text has no lines and stays null. Texts with fewer than three lines
that are not blank have no windows and stay as they are. Other columns stay. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.functions.once import bind
from reqsieve.llm.stored import settle

WINDOW = 3


def _mark(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).isNull(), F.col(text_col).isNull(), F.col(text_col))


def _windows(text: Column) -> Column:
    """array<struct<h1, h2, lines: the positions of its three lines>>"""
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(F.lower(F.trim(line)).alias("line"), i.alias("i")))

    def of(shown: Column) -> Column:
        three = F.arrays_zip(*[F.slice(shown, F.lit(k), F.greatest(F.lit(0), F.size(shown) - WINDOW + 1)).alias(f"l{k}") for k in (1, 2, 3)])
        return F.transform(three, lambda w: F.struct(
            F.xxhash64(w["l1"]["line"], w["l2"]["line"], w["l3"]["line"]).alias("h1"),
            F.xxhash64(F.lit(7), w["l3"]["line"], w["l2"]["line"], w["l1"]["line"]).alias("h2"),
            F.array(w["l1"]["i"], w["l2"]["i"], w["l3"]["i"]).alias("lines")))

    return bind(F.filter(lines, lambda x: x["line"] != ""), of)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, mark, removed``: for documents with later occurrences the positions they cover."""
    occurrences = settle(docs.select(
        F.col(id_col).cast("long").alias("id"), _mark(id_col, text_col).alias("mark"), F.inline(_windows(F.col(text_col)))))
    place = F.struct(F.col("id").isNull().alias("nameless"), F.col("id"), F.col("mark"), F.col("lines"))
    repeated = occurrences.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    again = occurrences.join(repeated, ["h1", "h2"], "left_semi").withColumn("place", place)
    first = again.groupBy("h1", "h2").agg(F.min("place").alias("first"))
    same = (F.col("place.nameless") == F.col("first.nameless")) & F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    last = F.element_at("first.lines", -1)
    covered = F.when(~same, F.col("lines")).otherwise(F.filter("lines", lambda i: i > last))
    later = again.join(first, ["h1", "h2"]).where(F.col("place") != F.col("first"))
    return later.select("id", "mark", F.explode(covered).alias("line")).groupBy("id", "mark").agg(
        F.array_sort(F.collect_set("line")).alias("removed"))


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines of later occurrences, with ``n_lines`` as they were and ``n_removed``."""
    found = repeated_lines(docs, id_col, text_col).select(
        F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("removed").alias("__removed"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    at = docs.select(*columns, _mark(id_col, text_col).alias("__at"))
    joined = at.join(found, (F.col("__at") == F.col("__mark")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("__removed", i)), "\n")
    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size("__removed"), F.lit(0)).alias("n_removed"))


#: The same over the table ``documents``, with exact lines in place of hashes.
ORACLE = r"""
with lines as (
    select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents
), shown as (
    select doc_id, i, lower(trim(line)) as l1,
           lead(lower(trim(line))) over w as l2, lead(lower(trim(line)), 2) over w as l3, lead(i) over w as i2, lead(i, 2) over w as i3
    from lines where trim(line) <> '' window w as (partition by doc_id order by i)
), placed as (
    select *, first_value(doc_id) over w as d, first_value(i3) over w as last, row_number() over w as nr
    from shown where l3 is not null window w as (partition by l1, l2, l3 order by doc_id, i)
), covered as (
    select distinct doc_id, p from (
        select doc_id, unnest([i, i2, i3]) as p, d, last from placed where nr > 1
    ) where doc_id <> d or p > last
), kept as (
    select l.doc_id, string_agg(line, chr(10) order by i) as text from lines l
    left join covered c on c.doc_id = l.doc_id and c.p = l.i where c.p is null group by l.doc_id
), removed as (select doc_id, count(*) as n from covered group by doc_id)
select d.doc_id, cast(len(string_split(d.text, chr(10))) as int) as n_lines, cast(coalesce(r.n, 0) as int) as n_removed,
       cast(length(coalesce(k.text, '')) as int) as n_kept_chars, md5(coalesce(k.text, '')) as text_md5
from documents d left join kept k on k.doc_id = d.doc_id left join removed r on r.doc_id = d.doc_id
"""
