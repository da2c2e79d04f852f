"""Language ID on the smallest pages, whose markup names the language, against a plain model, and on edge cases."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_id as L
from lodestone.llm import queries, textscan


def bins(text):
    low = bytes(c + 32 if 65 <= c < 91 else c for c in text.encode())
    out = []
    for word in re.findall(rb"[a-z\x80-\xff]+", low):
        padded = b" " + word + b" "
        out += [int(textscan.mix(np.array([int.from_bytes(padded[i : i + 3], "big")], np.uint64))[0]) % L.BUCKETS for i in range(len(padded) - 2)]
    return out


def model(pages, docs):
    """page_id to (language, probability), by loops over all pages."""
    langs = sorted({lang for _, lang in docs if lang})
    counts = {lang: Counter() for lang in langs}
    for text, lang in docs:
        if lang:
            counts[lang].update(bins(text or ""))
    total = {lang: sum(counts[lang].values()) + L.BUCKETS for lang in langs}

    def norm(weights):
        return {lang: w / sum(weights.values()) for lang, w in weights.items()}

    seen = {}
    for _, url, html in pages:
        url, html = url or "", html or ""
        found = Counter(bins(L.page_text(html)))
        n = sum(found.values())
        logs = {lang: sum(k * math.log((counts[lang][b] + 1) / total[lang]) for b, k in found.items()) * min(n, L.WITNESSES) / max(n, 1) for lang in langs}
        top = max(logs.values())
        own = norm({lang: math.exp(x - top) for lang, x in logs.items()})
        seen[url, html] = (logs, own, dict(zip(("host", "domain", "suffix", "tag"), L.address(url), strict=True)) | {"declared": L.declared(html)})
    sums = defaultdict(lambda: dict.fromkeys(langs, 0.0))
    for _, own, values in seen.values():
        for kind, value in [*values.items(), ("web", "")]:
            for lang in langs:
                sums[kind, value][lang] += own[lang]
    out = []
    for i, url, html in pages:
        logs, own, values = seen[url or "", html or ""]
        every = {lang: (sums["web", ""][lang] - own[lang] + 1) / (len(seen) - 1 + len(langs)) for lang in langs}

        def towards(kind, base):
            value = values[kind]
            others = {lang: sums[kind, value][lang] - own[lang] if value is not None else 0.0 for lang in langs}
            return norm({lang: others[lang] + (L.NAMED if kind in ("tag", "declared") and value == lang else 0) + L.SMOOTH * base[lang] for lang in langs})

        prior = towards("host", towards("domain", every))
        said = {kind: towards(kind, every) for kind in ("suffix", "tag", "declared")}
        final = {lang: logs[lang] + math.log(prior[lang]) + sum(math.log(s[lang] / every[lang]) for s in said.values()) for lang in langs}
        top = max(final.values())
        p = norm({lang: math.exp(x - top) for lang, x in final.items()})
        best = min(langs, key=lambda lang: (-p[lang], lang))
        out.append((i, best, p[best]))
    return out


ODD = [
    (1, None, None), (1, None, None), (None, "http://a.de/", ""), (3, "no address", "<p>"), (4, "HTTPS://U@News.Example.CO.UK:80/FR-fr/x", "<HTML xml:lang='DE-at'><p>x < y"), (5, "http://10.0.0.1/en/", "<meta content=es http-equiv=content-language>"),
    (6, "http://a.de/", "<html lang=xx>" + "<script>" * 3000), (7, "http://a.de/b", "<p>der die das " * 40000), (8, "http://a.de/b", "<p>der die das " * 40000), (9, "x://y", "\x00<!-- open"), (10, "http://a.de/c", "<" * 5000),
]


def test_against_loops(spark, small):
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").limit(80).collect()] + [("without", None), (None, "de"), ("blank", " ")]
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()] + ODD
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("page", F.lit(1)).withColumn("lang", F.lit("x"))
    got = sorted(((r.page_id or -1, r.lang, r.probability) for r in L.identify(table, spark.createDataFrame(docs, "text string, lang string")).collect()))
    want = sorted((i or -1, lang, p) for i, lang, p in model(pages, [(t, lang if lang != " " else None) for t, lang in docs]))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-6)


def test_languages_beyond_one_table(spark, small, monkeypatch):
    """With tables of two languages, pages are read several times and summed language by language; answers stay."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text", "lang").unionByName(spark.createDataFrame([(None, "qq"), ("zz zz zzz", "zz")], "text string, lang string"))
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(ODD, "page_id long, url string, html string"))
    answers = lambda: sorted((r.page_id or -1, r.lang, r.probability) for r in L.identify(pages, docs).collect())
    want = answers()
    monkeypatch.setattr(L, "TABLE_LANGUAGES", 2)
    got = answers()
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-6)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert L.identify(none, docs).count() == 0 and L.identify(pages, docs.limit(0)).where("lang is null").count() == len(want)


def test_more_than_five_hundred_languages(spark):
    name = lambda k: "l" + chr(97 + k // 26) + chr(97 + k % 26)
    docs = spark.createDataFrame([(f"{name(k) * 3} {name(k)[::-1] * 2}", name(k)) for k in range(600)], "text string, lang string")
    pages = spark.createDataFrame([(k, None, f"<p>{name(k) * 3} {name(k)[::-1] * 2}" * 3) for k in (0, 77, 599)], "page_id long, url string, html string")
    assert {r.page_id: r.lang for r in L.identify(pages, docs).collect()} == {k: name(k) for k in (0, 77, 599)}


def test_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bare = pages.withColumn("url", F.lit(None).cast("string")).withColumn("x", F.regexp_extract("html", 'lang="(..)"', 1)).withColumn("html", F.regexp_replace("html", ' lang="..\"', ""))
    for table in (pages.withColumn("x", F.regexp_extract("html", 'lang="(..)"', 1)), bare):
        rows = L.identify(table, docs).join(table, "page_id").collect()
        assert len(rows) == 50 and sum(r.lang == r.x for r in rows) >= 48 and all(0 <= r.probability <= 1 + 1e-9 for r in rows)
    found = {r.page_id: (r.lang, r.probability) for r in queries.op2_language_id(spark, small).collect()}
    copies = pages.unionByName(pages.where("page_id % 5 = 0")).unionByName(pages.where("page_id = 3"))
    again = L.identify(copies, docs).collect()
    assert len(again) == 61 and all(found[r.page_id][0] == r.lang and abs(found[r.page_id][1] - r.probability) < 1e-9 for r in again)


def test_reading():
    assert L.page_text('<script>var t="</p>";a<b</script>one<style>p{}</style> &eacute;<!-- x -->two<br>3 < 4') == " one  é two 3 < 4"
    assert L.address("https://fr.wiki.example.org/x") == ("fr.wiki.example.org", "example.org", "org", "fr") and L.address("http://a.b.com.br/") == ("a.b.com.br", "b.com.br", "br", None)
    assert L.address("ftp://host/pt-br/")[1:] == ("host", None, None) and L.address("") == (None,) * 4
    assert L.declared("<html class=x lang=fr-CA>") == "fr" and L.declared('<html><meta name="x" content="de"><meta content="es_MX" property="og:locale">') == "es" and L.declared("<p lang=de>") is None


def test_edges(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pages = spark.createDataFrame(ODD, "page_id long, url string, html string")
    rows = L.identify(pages, docs).collect()
    assert len(rows) == len(ODD) and all(r.lang == "de" for r in rows if r.page_id in (7, 8)) and {r.lang for r in rows if r.page_id == 5} == {"es"}
    assert L.identify(pages, docs.limit(0)).where("lang is null").count() == len(ODD)
    assert L.identify(pages.limit(0), docs).count() == 0
