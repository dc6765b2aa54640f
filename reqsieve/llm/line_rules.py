"""Quality rules with the frequency of lines across documents (operator 6). DataFrame functions only.

Each text is first judged alone: its words, the characters in them, symbols, lines that repeat earlier ones, and
words in three-word windows that occur more than once. Then every line, lower-cased and without white space around
it, is hashed, and the documents of its host that have it are counted. A line in more than ``LINE_SHARE`` of the
host's documents, and in more than ``LINE_DOCS`` of them, is boilerplate and is removed. A document
that loses more than ``LOST_PERCENT`` of its words so is rejected, as is one that fails alone. ``rules`` gives the
verdicts and what they rest on, ``without_frequent_lines`` the documents that are kept, without these lines. Both
limits hold at once, so a host with ``LINE_DOCS`` documents or fewer loses no line.

Lines are counted after they have been reduced to one row per document and line, so a line that a third of
all documents share is many rows only of different documents, which are added up before the shuffle. Nothing
but hashes and counts is shuffled; texts meet the positions of their removed lines in one join.

Defined results: a null text is empty; null hosts are one host. Repeated rows (equal ids, hosts and texts) are one
document, and each is returned. Documents with no lines lose nothing. Other columns are ignored. An empty
table gives no rows. Three-word windows and lines are told apart by 64 and 128 bits of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.functions.once import bind, once
from reqsieve.llm.stored import settle

LINE_SHARE, LINE_DOCS, LOST_PERCENT = 0.01, 100, 50
LEAST_WORDS, REPEAT_PERCENT = 50, 50

# White space between words, and symbols.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
BETWEEN = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]+"


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def split_words(trimmed: Column) -> Column:
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BETWEEN, -1))


def repeated_words(words: Column) -> Column:
    """How many words are in three-word windows that the text has twice or more."""
    n = F.greatest(F.lit(0), F.size(words) - 2)
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, F.slice(words, F.lit(3), n), lambda a, b: F.xxhash64(a, b))

    def positions(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def neighbours(s: Column) -> Column:
            m = F.size(s) - 1
            met = F.zip_with(F.slice(s, F.lit(1), m), F.slice(s, F.lit(2), m), lambda a, b: F.when(a["h"] == b["h"], F.array(
                a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
            return F.size(F.array_distinct(F.flatten(F.filter(met, lambda x: x.isNotNull()))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bind(placed, neighbours))

    return bind(windows, positions)


def _lines(text: Column) -> Column:
    """array<struct<line, key, words, position>> of the lines with a word."""
    each = F.transform(F.split(text, "\n", -1), lambda line, i: bind(_trimmed(line), lambda t: F.struct(
        line.alias("line"), F.xxhash64(F.lower(t)).alias("h1"), F.xxhash64(F.lit(7), F.lower(t)).alias("h2"),
        F.size(split_words(t)).alias("words"), i.alias("i"))))
    return F.filter(each, lambda x: x["words"] > 0)


def _doc(id_col: str, text_col: str, host_col: str) -> Column:
    """What equal rows have in common."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.col(host_col).isNull(), F.col(host_col), F.coalesce(F.col(text_col), F.lit("")))


def judged(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """What a text says alone, and its lines as hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(host_col).isNull(), F.col(host_col)).alias("host"),
        _doc(id_col, text_col, host_col).alias("doc"), text.alias("text"))
    rows = once(rows, words=split_words(_trimmed(F.col("text"))), lines=_lines(F.col("text")))
    return rows.select(
        "doc_id", "host", "doc", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOL, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct(F.col("lines.line")))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(x["h1"], x["h2"], x["words"], x["i"])).alias("lines"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_share: float = LINE_SHARE,
             line_docs: int = LINE_DOCS, lost_percent: int = LOST_PERCENT) -> DataFrame:
    """What ``rules`` gives, with ``doc`` (alike for equal rows) and ``removed``, the positions of removed lines or null."""
    base = settle(judged(docs, id_col, text_col, host_col))
    lines = base.select("host", "doc", "n_words", F.inline("lines")).select("host", "doc", "n_words", "h1", "h2", "words").distinct().groupBy(
        "host", "doc", "h1", "h2").agg(F.count("*").alias("n"))
    in_docs = lines.groupBy("host", "h1", "h2").agg(F.count("*").alias("docs")).where(F.col("docs") > line_docs)
    hosts = base.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("of"))
    frequent = settle(in_docs.join(hosts, "host").where(F.col("docs") > line_share * F.col("of")).select("host", "h1", "h2"))
    each = base.select("host", "doc", F.inline("lines"))
    lost = each.join(frequent, ["host", "h1", "h2"], "left_semi").groupBy("doc").agg(  # of one document
        F.array_sort(F.collect_set(F.struct("i", "words"))).alias("lost"))
    removed = lost.select("doc", F.col("lost.i").alias("removed"), F.aggregate(
        "lost", F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("n_removed_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    n_removed = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    return base.drop("lines").join(removed, "doc", "left").select(
        "doc", "removed", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        n_removed.alias("n_removed_words"), (~failed & (100 * n_removed <= lost_percent * F.col("n_words"))).alias("kept"))


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept``, a row per document."""
    return verdicts(docs, id_col, text_col, host_col, **limits).drop("doc", "removed")


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents that are kept, without the lines that count as removed. Other columns stay."""
    found = verdicts(docs, id_col, text_col, host_col, **limits).where("not kept or removed is not null")
    # Written down, so that Spark knows its size and leaves the texts where they are if it is small.
    changed = settle(found.select(F.col("doc").alias("__doc"), F.col("kept").alias("__kept"), F.col("removed").alias("__removed")).distinct())
    at = docs.withColumn("__at", _doc(id_col, text_col, host_col))
    joined = at.join(changed, F.col("__at") == F.col("__doc"), "left").where(F.coalesce("__kept", F.lit(True)))
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda line, i: ~F.array_contains("__removed", i)), "\n")
    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(left)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


#: The same over the table ``documents``, with exact lines and windows in place of hashes.
ORACLE = rf"""
with texts as (
    select doc_id, source, coalesce(text, '') as text, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from documents
), words as (
    select doc_id, source, text, case when t = '' then [] else regexp_split_to_array(t, '[\x20\x09-\x0D]+') end as w from texts
), windows as (
    select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) > 2)
), again as (
    select doc_id, i from windows qualify count(*) over (partition by doc_id, a, b, c) > 1
), repeats as (
    select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id
), lines as (
    select doc_id, source, line, lower(t) as l, len(regexp_split_to_array(t, '[\x20\x09-\x0D]+')) as n from (
        select doc_id, source, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from (
            select doc_id, source, unnest(string_split(text, chr(10))) as line from words))
    where t <> ''
), dup_lines as (select doc_id, count(*) - count(distinct line) as n from lines group by doc_id
), hosts as (select source, count(*) as n from documents group by source
), frequent as (
    select l.source, l.l from lines l join hosts h on h.source is not distinct from l.source group by l.source, l.l, h.n
    having count(distinct doc_id) > {LINE_DOCS} and count(distinct doc_id) > {LINE_SHARE} * h.n
), lost as (
    select doc_id, sum(n) as n from lines l join frequent f on f.source is not distinct from l.source and f.l = l.l group by doc_id
), base as (
    select w.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
           cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
           cast(coalesce(d.n, 0) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words,
           cast(coalesce(x.n, 0) as bigint) as n_removed_words
    from words w left join dup_lines d using (doc_id) left join repeats r using (doc_id) left join lost x using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed, n_removed_words,
       not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) and 100 * n_removed_words <= {LOST_PERCENT} * n_words as kept
from base
"""
