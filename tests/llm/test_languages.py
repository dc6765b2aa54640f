"""Language fusion against plain loops, its accuracy, and odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from reqsieve.llm import languages
from reqsieve.llm.queries import QUERIES


def buckets(text):
    data = [b if 0x61 <= b < 0x7B or b >= 0x80 else 0x20 for b in (text or "").encode().lower()]
    out = []
    for i, b in enumerate(data):
        if b != 0x20:
            before, after = data[i - 1] if i else 0x20, data[i + 1] if i + 1 < len(data) else 0x20
            out.append(((before << 16 | b << 8 | after) * 0x9E3779B1 % (1 << 32)) >> 18)
    return out


def shares(logs):
    top = max(logs)
    out = [math.exp(x - top) for x in logs]
    return [x / sum(out) for x in out]


def differs(own, known, letters):
    """The test of a code's letters (bucket -> n) against languages (their smoothed chances by bucket, their letters)."""
    total, weights = sum(own.values()), [1 / len(known)] * len(known)
    for _ in range(languages.ROUNDS):
        mixed = {b: sum(w * k(b) for w, k in zip(weights, known)) for b in own}
        weights = [w * sum(n / total * k(b) / mixed[b] for b, n in own.items()) for w, k in zip(weights, known)]
    mixed = {b: sum(w * k(b) for w, k in zip(weights, known)) for b in own}
    divergence = sum(n / total * math.log(n / total / mixed[b]) for b, n in own.items())
    by_chance = (len(own) - 1) / 2 * (1 / total + sum(w / m for w, m in zip(weights, letters)))
    return divergence > languages.MARGIN + languages.DISPERSION * by_chance


def by_loop(rows):
    """id -> language, confidence, letters, by the definition; rows are id, text, declared, address."""
    rows = [(i, t, d if d and re.fullmatch("[a-z]{2,3}", d) else None, a) for i, t, d, a in rows]
    declared = [r[2] for r in rows if r[2]]
    model, known, sizes = {}, [], []
    for n in sorted(set(declared), key=lambda d: (-declared.count(d), d)):
        if declared.count(n) < languages.LEAST_DOCS:
            continue
        own = defaultdict(int)
        for _, t, d, _ in rows:
            if d == n:
                for b in buckets(t):
                    own[b] += 1
        total = sum(own.values()) + languages.TEXT_ADDED * languages.BUCKETS
        if own and (not known or differs(dict(own), known, sizes)):
            sums = defaultdict(lambda: languages.TEXT_ADDED, {b: c + languages.TEXT_ADDED for b, c in own.items()})
            model[n] = sums, total
            sizes.append(sum(own.values()))
            known.append(lambda b, s=dict(sums), t=total: s.get(b, languages.TEXT_ADDED) / t)
    names = sorted(model)
    logs, share = [], []
    for _, t, _, _ in rows:
        found = buckets(t)
        logs.append([languages.TEMPER * sum(math.log(model[n][0].get(b, languages.TEXT_ADDED) / model[n][1]) for b in found) for n in names])
        logs[-1].append(-languages.TEMPER * math.log(languages.BUCKETS) * len(found) if found else -math.inf)
        first = [math.log(declared.count(n) / sum(declared.count(x) for x in names)) for n in names] + [math.log(languages.UNKNOWN)]
        share.append(shares([a + b for a, b in zip(logs[-1], first)])[:-1] if found else [0.0] * len(names))
    sums = defaultdict(lambda: np.zeros(len(names)))
    places = []
    for (_, _, d, a), s in zip(rows, share):
        host = a.lower().split("://")[-1].split("/")[0] if a else None
        domain = ".".join(host.split(".")[-2:]) if host else None
        suffix = host.split(".")[-1] if host and "." in host else None
        places.append((host, domain, suffix, d))
        for kind, key in (("all", ""), ("host", host), ("domain", domain), ("suffix", suffix), ("declared", d)):
            sums[kind, key] = sums[kind, key] + np.array(s)
    out, total, added = {}, sums["all", ""], languages.LEVEL_ADDED
    kinds = len(set(declared) | set(names))
    for (i, t, d, _), l, s, (host, domain, suffix, _) in zip(rows, logs, share, places):
        s = np.array(s)
        overall = np.maximum(total - s, 0) + 1
        prior = overall / overall.sum()
        for kind, key in (("domain", domain), ("host", host)):
            n = np.maximum(sums[kind, key] - s, 0) if key else np.zeros(len(names))
            prior = (n + added * prior) / (n.sum() + added)
        after, unknown = np.array(l[:-1]) + np.log(prior), l[-1] + math.log(languages.UNKNOWN)
        if suffix:
            n = np.maximum(sums["suffix", suffix] - s, 0)
            after += np.log((n + added * (n.sum() + 1) / (total.sum() + 1)) / (overall + added))
            unknown += math.log((n.sum() + 1) / (total.sum() + 1))
        if d:
            seen = np.maximum(sums["declared", d] - s, 0)
            own = np.array([kinds if n == d else 0 for n in names])
            after += np.log((seen + 1 + own) / (overall + 2 * kinds))
            unknown += math.log(declared.count(d) / len(declared))
        p = shares([*after.tolist(), unknown])
        out[i] = [*names, None][int(np.argmax(p))], max(p), len(buckets(t))
    return out


def test_against_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 80")
    docs = docs.selectExpr("doc_id", "if(doc_id in (3, 9), repeat('\u4f60\u597d\u4e16\u754c ', 40), substr(text, 1, 500 * (doc_id % 5))) text", "if(doc_id % 7 = 0, 'zz', if(doc_id % 11 = 0 or doc_id in (3, 9), null, lang)) lang",
                           "concat('http://', if(doc_id % 2 = 0, 'www.', ''), source, '.', if(doc_id % 3 = 0, 'org', lang), '/x') source")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    want = by_loop(rows)
    for r in languages.identify(docs.repartition(3)).collect():
        language, confidence, letters = want[r.doc_id]
        assert (r.language, r.n_letters) == (language, letters) and r.confidence == pytest.approx(confidence, rel=1e-4)
        assert r.kept == (letters > 0 and language is not None and r.confidence >= 0.5)
    found = {v[0] for v in want.values()}
    assert None in found and "zz" not in found and len(found) >= 4  # junk is no language, and what fits none is unknown


def test_query(spark, sf_dir):
    rows = QUERIES["op1_languages"](spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert sum(r.language == docs[r.doc_id].lang for r in rows) >= 0.98 * len(rows)
    assert all(r.kept for r in rows if r.n_letters > 20)


def test_wrong_declarations_are_outvoted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 300")
    wrong = docs.selectExpr("doc_id", "text", "if(doc_id % 6 = 0, if(lang = 'en', 'fr', 'en'), lang) lang", "source")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = languages.identify(wrong).collect()
    assert sum(r.language == truth[r.doc_id] for r in got) >= 0.95 * len(got)


def test_pages(spark, sf_dir):
    rows = QUERIES["page_languages"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r.declared for r in rows) and sum(r.language == r.declared for r in rows) >= 0.9 * len(rows)


def test_odd_pages(spark, table):
    html = '<HTML lang="%s"><script>var x = "</p>";</script><p>%s</p><!-- <b>no</b> -->'
    texts = {"en": "the house and the garden were here before the river rose again ", "de": "der garten und das haus waren schon da bevor der fluss stieg "}
    rows = [(i, f"http://h{i % 3}.org/x", html % (lang, t * 20), "clash") for i, (lang, t) in enumerate(list(texts.items()) * 8)]
    odd = [(100, None, None, None), (101, "", "", ""), (102, "not a url", "<html lang=>  ", "x"), (None, "http://a.de/", html % ("de", texts["de"]), "x"),
           (103, "http://a.de/", texts["de"] * 9, None), (104, "http://a.de/", "<script>only()", "x"), (0, rows[0][1], rows[0][2], "again")]
    got = languages.of_pages(table([*rows, *odd], "page_id long, url string, html string, language string"))
    by = defaultdict(list)
    for r in got.collect():
        by[r.page_id].append((r.language, r.kept))
    assert all(by[i][0] == (lang, True) for i, lang in enumerate(["en", "de"] * 8)) and by[0] == [("en", True)] * 2
    assert [by[i][0][1] for i in (100, 101, 102, 103)] == [False, False, False, True] and by[None] == by[103] == [("de", True)]
    assert languages.of_pages(table([], "page_id long, url string, html string")).count() == 0
    assert got.columns == ["page_id", "declared", "language", "confidence", "n_letters", "kept"]


def test_odd_rows(spark, odd):
    got = languages.identify(odd.selectExpr("*", "text as language", "1 as share", "lang as host")).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert not by[0].kept and not by[1].kept and not by[2].kept and by[9].kept
    nothing = languages.identify(odd.selectExpr("doc_id", "text", "cast(null as string) lang", "source")).collect()
    assert len(nothing) == odd.count() and not any(r.kept or r.language for r in nothing)
    assert languages.identify(odd.limit(0)).count() == 0


def test_parts_of_addresses(spark, table):
    df = table([("http://u:p@WWW.Ex.co.de:80/x",), ("src0",), ("https://1.2.3.4/",), (None,), ("",), ("http://",)], "a string")
    host = languages.host_of(df.a)
    got = [tuple(r) for r in df.select(host, languages.domain_of(host), languages.suffix_of(host)).collect()]
    assert got == [("www.ex.co.de", "co.de", "de"), ("src0", "src0", None), ("1.2.3.4", "3.4", None), *[(None, None, None)] * 3]


def maker(draw):
    """Texts of an invented language."""
    syllables = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(60)]
    stems = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(300)]
    return lambda: " ".join(draw.choice(stems) for _ in range(30))


def test_random_codes_are_no_languages(spark, table):
    """A thousand codes on texts of two languages, one of them on a large share: no rightly declared row is changed."""
    draw = random.Random(6)
    texts = {"aa": maker(draw), "bb": maker(draw)}
    codes = [a + b + c for a in "xyz" for b in "abcdefghijklmnopqrs" for c in "abcdefghijklmnopqr"][:1000]
    rows = [(lang, lang) for lang in texts for _ in range(3000)] + [("aa", "zz")] * 300 + [(lang, "qq") for lang in texts for _ in range(200)]
    rows += [(draw.choice(["aa", "bb"]), c) for c in codes for _ in range(6)]
    rows = [(i, texts[lang](), code, f"h{i % 9}.org", lang) for i, (lang, code) in enumerate(rows)]
    df = table(rows, "doc_id long, text string, lang string, source string, truth string").repartition(4)
    said = {r.lang: r["count"] for r in df.groupBy("lang").count().collect()}
    names, model = languages.text_model(df.selectExpr("text", "lang as declared"), said)
    assert names == ["aa", "bb"] and model.shape == (2, languages.BUCKETS)
    got = {r.doc_id: r for r in languages.identify(df).collect()}
    assert all((got[i].language, got[i].kept) == (truth, True) for i, *_, truth in rows)


def test_divergence():
    draw = np.random.default_rng(7)
    one, two = (draw.dirichlet(np.full(languages.BUCKETS, 0.05)) for _ in range(2))
    known, letters = np.array([one, two]) + 1e-9, np.array([1e9, 1e9])
    near = 0.9 * one + 0.1 * draw.dirichlet(np.full(languages.BUCKETS, 0.05))
    for n in (2_000, 200_000):
        assert not languages.differs(draw.multinomial(n, one), known, letters)
        assert not languages.differs(draw.multinomial(n, 0.3 * one + 0.7 * two), known, letters)
        assert languages.differs(draw.multinomial(n, draw.dirichlet(np.full(languages.BUCKETS, 0.05))), known, letters)
    assert languages.differs(draw.multinomial(500_000, near), known, letters)
    assert not languages.differs(np.zeros(languages.BUCKETS, int), known, letters) and languages.differs(draw.multinomial(9, one), known[:0], letters[:0])


def test_rare_and_unknown_languages(spark, table):
    """A tenth of a percent is a language, three documents are not: they are rejected, not given another one."""
    draw = random.Random(5)
    rows = []
    for lang, n in (("aa", 12_000), ("bb", 7_965), ("rr", 20), ("uu", 3)):
        text = maker(draw)
        rows += [(len(rows) + k, text(), lang, f"h{k % 9}.org") for k in range(n)]
    rows += [(len(rows), rows[19_970][1], "aa", "h1.org"), (len(rows) + 1, rows[19_971][1], None, None)]
    got = {r.doc_id: r for r in languages.identify(table(rows, "doc_id long, text string, lang string, source string").repartition(4)).collect()}
    for i, _, lang, _ in rows[:-2]:
        assert (got[i].language, got[i].kept) == ((None, False) if lang == "uu" else (lang, True)), rows[i]
    assert all((got[i].language, got[i].kept) == ("rr", True) for i, *_ in rows[-2:])
    docs = table(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in docs.exceptAll(languages.drop_unidentified(docs)).collect()} == {i for i, _, lang, _ in rows if lang == "uu"}
