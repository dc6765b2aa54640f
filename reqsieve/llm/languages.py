"""Languages by Bayesian fusion of evidence (operator 1).

The posterior of a language is the product of four things:

- the likelihood of the text: letters with their neighbours (hashed to ``BUCKETS``), smoothed and tempered by
  ``TEMPER`` because neighbours overlap; learnt from all rows that declare a language;
- the likelihood of the declared language (of the markup, or a table's own column), from how often the texts of
  each language declare which;
- the likelihood of the address suffix (``de``, ``org``), smoothed with how frequent the suffix is;
- the prior of the host, smoothed with that of its domain, and this with the global one.

The last three come from one grouped aggregation of the languages that the texts alone suggest (as shares, so that
a text of unclear language counts for each a little), and a row's own share is taken out before it meets
them. A declared code is a language if at least ``LEAST_DOCS`` rows declare it and their letters differ from every mixture of
the languages that more rows declare: the divergence from the nearest mixture must exceed ``MARGIN`` and what so few
letters on both sides show by chance. So codes that are declared at random, on texts of one language or of many, are evidence like
any declaration, but no languages, and a rare language stays one however much there is of others. Codes of at least the
share ``LEAST_SHARE`` (200 at most) are tested one after the other, the rarer ones in tasks and only against the languages
among these. The text model has one row of ``BUCKETS`` numbers (64 KB) for each language, and a row of the table a number
for each; letters are counted in a table, a code and bucket a row, and tasks hold the counts of ``HELD`` codes.

Beside them stands an unknown language, for texts that fit no model better than chance: all buckets alike, with the prior
``UNKNOWN``, and for declarations and suffixes how often they occur at all. A text of a language that too few rows
declare is rejected so where its letters are unlike those of all others; where they are like, it gets the nearest one. Texts are read twice and never shuffled; a row is a few numbers
from then on, and a host that has a third of all rows is a few sums that meet these rows in one join.

Defined results: a text without letters says nothing; it is rejected, as is one whose best language has a
posterior below ``LEAST_CONFIDENCE``. A text whose best language is the unknown one is rejected with a null language and
the posterior of the unknown one. A null or unusable declaration or address is no evidence. Without any
declared language the result is null and all is rejected. Each row gives a row; repeated rows count as often as they
occur. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.stored import only, settle
from reqsieve.llm.words import Slice, slices

BUCKETS = 1 << 14
LEAST_SHARE = 0.005
LEAST_DOCS = 5
#: Divergence (in nats) from the nearest mixture of others that makes a language; how much more than by chance it has to be.
MARGIN, DISPERSION = 0.05, 8.0
#: Steps to the nearest mixture.
ROUNDS = 50
#: Text bytes that are turned into arrays at a time.
SLICE = 400_000
#: Codes whose letters a task counts at a time.
HELD = 64
#: Prior of the unknown language.
UNKNOWN = 1e-3
LEAST_CONFIDENCE = 0.5
TEMPER = 1 / 3
#: Pseudo-counts: of the text model, of declarations, of suffixes, and of the levels of the host prior.
TEXT_ADDED, DECLARED_ADDED, LEVEL_ADDED = 0.05, 1.0, 10.0

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_SPACE = 0x20


def declared_language(value: Column) -> Column:
    """The primary subtag in lower case; null if it is none."""
    tag = F.regexp_extract(F.lower(F.trim(value)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag)


def host_of(address: Column) -> Column:
    """The host of a URL, or an address without a scheme as it is; null if there is none."""
    low = F.lower(F.trim(address))
    host = F.when(low.contains("://"), F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)).otherwise(low)
    return F.when(host != "", host)


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    suffix = F.substring_index(host, ".", -1)
    return F.when(host.contains(".") & suffix.rlike("^[a-z]{2,}$"), suffix)


def neighbours(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each letter with its neighbours, and where the letters of each text begin."""
    letter = _LETTER[part.data]
    plain = np.where(letter, part.data, _SPACE).astype(np.uint32)
    before, after = np.roll(plain, 1), np.roll(plain, -1)
    filled = np.flatnonzero(np.diff(part.bounds))
    before[part.bounds[:-1][filled]] = _SPACE
    after[part.bounds[1:][filled] - 1] = _SPACE
    at = np.flatnonzero(letter)
    code = (before[at] << np.uint32(16)) | (plain[at] << np.uint32(8)) | after[at]
    return bucket(code), np.searchsorted(at, part.bounds)


def bucket(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)


def letter_counts(rows: DataFrame, codes: list[str]) -> DataFrame:
    """``code, bucket, n``: the letters of all rows that declare one of the codes, numbered as listed."""
    number = {name: i for i, name in enumerate(codes)}

    def given(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, n in sums.items():
            where = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(where), i, np.int32)), pa.array(where.astype(np.int32)), pa.array(n[where])], ["code", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            declared = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()])
            for part in slices(batch.column(0), SLICE):
                found, begins = neighbours(part)
                of = np.repeat(declared[part.first: part.first + len(part)], np.diff(begins))
                order = np.argsort(of, kind="stable")
                of, found = of[order], found[order]
                cuts = np.flatnonzero(np.diff(of, prepend=-1))
                for lo, hi in zip(cuts, np.append(cuts[1:], len(of))):
                    i = int(of[lo])
                    sums[i] = sums.get(i, 0) + np.bincount(found[lo:hi], minlength=BUCKETS)
                    if len(sums) > HELD:
                        yield from given(sums)
                        sums = {}
        yield from given(sums)

    declared = rows.where("declared is not null").select("text", "declared")
    if len(codes) <= HELD:
        declared = declared.where(F.col("declared").isin(codes))
    found = declared.mapInArrow(count, "code int, bucket int, n long").where("code >= 0")
    return settle(found.groupBy("code", "bucket").agg(F.sum("n").alias("n")))


def differs(counts: np.ndarray, known: np.ndarray, letters: np.ndarray) -> bool:
    """Do letters (counts by bucket) differ from every mixture of the known languages (chances by bucket, and from how many letters)?"""
    at = np.flatnonzero(counts)
    if not len(at) or not len(known):
        return len(at) > 0
    total, chances = counts.sum(), known[:, at].astype(float)
    share, weights = counts[at] / total, np.full(len(known), 1 / len(known))
    for _ in range(ROUNDS):
        weights = weights * (chances @ (share / (weights @ chances)))
    divergence = (share * np.log(share / (weights @ chances))).sum()
    by_chance = (len(at) - 1) / 2 * (1 / total + (weights / letters).sum())
    return bool(divergence > MARGIN + DISPERSION * by_chance)


def _chances(counts: DataFrame, wanted: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the wanted codes by bucket, and the smoothed chances that they give."""
    place = np.full(max(wanted) + 1, -1)
    place[wanted] = np.arange(len(wanted))
    sums = np.zeros((len(wanted), BUCKETS))
    for batch in counts.where(F.col("code").isin(wanted)).toArrow().to_batches():  # at most a number per code and bucket
        sums[place[batch.column(0).to_numpy()], batch.column(1).to_numpy()] += batch.column(2).to_numpy()
    return sums, (sums + TEXT_ADDED) / (sums.sum(axis=1, keepdims=True) + TEXT_ADDED * BUCKETS)


def text_model(rows: DataFrame, said: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """The languages among the declared codes (with their rows), and log likelihoods by language and bucket."""
    codes = sorted((c for c, n in said.items() if n >= LEAST_DOCS), key=lambda c: (-said[c], c))
    if not codes:
        return [], np.zeros((0, BUCKETS), np.float32)
    counts, total = letter_counts(rows, codes), sum(said.values())
    large = [i for i, c in enumerate(codes) if said[c] >= LEAST_SHARE * total] or [0]
    sums, chances = _chances(counts, large)
    found: list[int] = []
    for i in large:
        if differs(sums[i], chances[found], sums[found].sum(axis=1)):
            found.append(i)
    if len(large) < len(codes):
        core = rows.sparkSession.sparkContext.broadcast((chances[found].astype(np.float32), sums[found].sum(axis=1)))

        def tested(table: pa.Table) -> pa.Table:
            own = np.zeros(BUCKETS)
            own[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
            code = table.column("code").slice(0, 1).cast(pa.int32())
            return pa.table({"code": code if differs(own, *core.value) else code.slice(0, 0)})

        rare = counts.where(F.col("code") >= len(large)).groupBy("code").applyInArrow(tested, "code int")
        found += [r.code for r in rare.collect()]  # codes of two or three letters
    names = sorted(codes[i] for i in found)
    _, chances = _chances(counts, [codes.index(c) for c in names]) if names else (None, np.zeros((0, BUCKETS)))
    return names, np.log(chances).astype(np.float32)


def _shares(logs: np.ndarray) -> np.ndarray:
    out = np.exp(logs - logs.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _rows(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def identify(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang",
             address_col: str | None = "source", least_confidence: float = LEAST_CONFIDENCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``<id>, declared, language, confidence, n_letters, kept`` and the columns to keep, a row per record."""
    spark, nothing = records.sparkSession, F.lit(None).cast("string")
    rows = only(
        records, doc_id=F.col(id_col), text=F.col(text_col).cast("string"),
        declared=declared_language(F.col(declared_col).cast("string")) if declared_col else nothing,
        host=host_of(F.col(address_col).cast("string")) if address_col else nothing, **{f"kept_{c}": c for c in keep})
    id_type = dict(rows.dtypes)["doc_id"]
    declaring = rows.where("declared is not null").groupBy("declared").agg(F.count("*").alias("n"))
    said = {r.declared: r.n for r in declaring.collect()}  # codes of two or three letters
    total = sum(said.values())
    languages, likelihoods = text_model(rows, said)
    kept = [F.col(f"kept_{c}").alias(c) for c in keep]
    if not languages:
        return rows.select(F.col("doc_id").alias(id_col), "declared", nothing.alias("language"), F.lit(0.0).alias("confidence"),
                           F.lit(0).cast("long").alias("n_letters"), F.lit(False).alias("kept"), *kept)
    width, number = len(languages), {name: i for i, name in enumerate(languages)}
    declares = np.array([said[x] for x in languages], float)
    first_prior = np.log(np.append(declares / declares.sum(), UNKNOWN))
    frequencies = {code: n / total for code, n in said.items()}
    model = spark.sparkContext.broadcast(likelihoods)
    extra = [c for c in rows.columns if c.startswith("kept_")]
    extra_types = "".join(f", {c} {dict(rows.dtypes)[c]}" for c in extra)

    def text_evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            for part in slices(batch.column(1), SLICE):
                found, begins = neighbours(part)
                logs = np.empty((len(part), width + 1))
                for i in range(width):
                    sums = np.concatenate(([0.0], np.cumsum(table[i][found], dtype=np.float64)))
                    logs[:, i] = TEMPER * (sums[begins[1:]] - sums[begins[:-1]])
                letters = np.diff(begins)
                logs[:, width] = np.where(letters > 0, -TEMPER * np.log(BUCKETS) * letters, -np.inf)
                share = np.where(letters[:, None] > 0, _shares(logs + first_prior), 0.0)[:, :width]
                size = len(part)
                yield pa.record_batch(
                    [batch.column(0).slice(part.first, size), *[batch.column(i).slice(part.first, size) for i in range(2, batch.num_columns)],
                     pa.array(letters), _rows(logs), _rows(share)],
                    ["doc_id", "declared", "host", *extra, "n_letters", "logs", "share"])

    alone = settle(rows.mapInArrow(
        text_evidence, f"doc_id {id_type}, declared string, host string{extra_types}, n_letters long, logs array<double>, share array<double>"))

    sums = [F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(width)]
    packed = F.array(*[f"s{i}" for i in range(width)])

    def summed(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*sums)

    def resummed(df: DataFrame, key: Column, name: str) -> DataFrame:
        again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]
        return df.groupBy(key.alias(name)).agg(*again).where(F.col(name).isNotNull()).select(name, packed.alias(f"{name}_sums"))

    hosts = settle(summed(alone.where("host is not null"), "host"))
    by_host = (
        hosts.select("host", packed.alias("host_sums"), domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
        .join(resummed(hosts, domain_of(F.col("host")), "domain"), "domain", "left")
        .join(resummed(hosts, suffix_of(F.col("host")), "suffix"), "suffix", "left"))
    everywhere = np.array(summed(alone).first(), float)
    by_declared = {r.declared: np.array(r[1:], float) for r in summed(alone.where("declared is not null"), "declared").collect()}
    context = (languages, number, everywhere, by_declared, [x for x in by_declared if x not in number], frequencies)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            logs, share = _matrix(column["logs"], width + 1), _matrix(column["share"], width)
            host, domain, suffix = (_matrix(column[n], width) for n in ("host_sums", "domain_sums", "suffix_sums"))
            total_logs = logs + fused(share, host, domain, suffix, column["suffix_known"].to_numpy(zero_copy_only=False).astype(bool),
                                      column["declared"].to_pylist(), *context)
            after = _shares(total_logs)
            best = after.argmax(axis=1)
            confidence = after[np.arange(len(best)), best]
            letters = column["n_letters"].to_numpy()
            yield pa.record_batch([
                column["doc_id"], column["declared"], pa.array([languages[i] if i < width else None for i in best], pa.string()), pa.array(confidence),
                column["n_letters"], pa.array((letters > 0) & (best < width) & (confidence >= least_confidence)), *[column[c] for c in extra],
            ], [id_col, "declared", "language", "confidence", "n_letters", "kept", *extra])

    none = F.array(*[F.lit(0.0)] * width)
    joined = alone.join(by_host, "host", "left").select(
        "doc_id", "declared", *extra, "n_letters", "logs", "share", *[F.coalesce(f"{n}_sums", none).alias(f"{n}_sums") for n in ("host", "domain", "suffix")],
        F.col("suffix_sums").isNotNull().alias("suffix_known"))
    out = joined.mapInArrow(
        fuse, f"`{id_col}` {id_type}, declared string, language string, confidence double, n_letters long, kept boolean{extra_types}")
    return out.select(f"`{id_col}`", "declared", "language", "confidence", "n_letters", "kept", *kept)


def fused(share: np.ndarray, host: np.ndarray, domain: np.ndarray, suffix: np.ndarray, suffix_known: np.ndarray, declared: list[str | None],
          languages: list[str], number: dict[str, int], everywhere: np.ndarray, by_declared: dict[str, np.ndarray], others: list[str],
          frequencies: dict[str, float]) -> np.ndarray:
    """log of prior, suffix and declaration for rows (by languages, the unknown one last), each without the row's own share."""

    def without(sums: np.ndarray) -> np.ndarray:
        return np.maximum(sums - np.where(sums.sum(axis=1, keepdims=True) > 0, share, 0.0), 0.0)

    overall = np.maximum(everywhere - share, 0.0) + 1.0
    prior = overall / overall.sum(axis=1, keepdims=True)
    for sums in (without(domain), without(host)):
        prior = (sums + LEVEL_ADDED * prior) / (sums.sum(axis=1, keepdims=True) + LEVEL_ADDED)
    out, unknown = np.log(prior), np.full(len(share), np.log(UNKNOWN))

    there = without(suffix)
    frequency = (there.sum(axis=1, keepdims=True) + 1.0) / (everywhere.sum() + 1.0)
    likely = (there + LEVEL_ADDED * frequency) / (overall + LEVEL_ADDED)
    out += np.where(suffix_known[:, None], np.log(likely), 0.0)
    unknown += np.where(suffix_known, np.log(frequency[:, 0]), 0.0)

    names = len(languages) + len(others)
    for name in {x for x in declared if x is not None}:
        rows = np.array([x == name for x in declared])
        own = np.zeros(len(languages))
        if name in number:  # before anything is seen, a declaration is more likely right than wrong
            own[number[name]] = names
        seen = np.maximum(by_declared[name] - share[rows], 0.0)
        out[rows] += np.log((seen + DECLARED_ADDED * (1 + own)) / (overall[rows] + DECLARED_ADDED * 2 * names))
        unknown[rows] += np.log(frequencies[name])
    return np.column_stack((out, unknown))


def of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """The same for web pages: their visible text, the language their markup declares, and their address."""
    html = F.col(html_col)
    visible = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ")
    declared = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    return identify(pages.select(F.col(id_col), visible.alias("text"), declared.alias("lang"), F.col(url_col).alias("source")), id_col, **options)


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang",
                      address_col: str = "source", **options) -> DataFrame:
    """The documents whose language is clear enough, as they are. Equal rows are decided alike."""
    used = [id_col, text_col, declared_col, address_col]
    mark = F.xxhash64(*[x for c in used for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])
    found = identify(docs.withColumn("__mark", mark), id_col, text_col, declared_col, address_col, keep=("__mark",), **options)
    # Written down, so that Spark knows its size and leaves the texts where they are if it is small.
    rejected = settle(found.where(~F.col("kept")).select("__mark").distinct())
    return docs.withColumn("__mark", mark).join(rejected, "__mark", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
