"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence are multiplied, each learned from the tables themselves:

- Text: trigrams of letters, hashed into ``BUCKETS`` bins, counted by language over all
  documents. The table of the likelihoods of ``TABLE_LANGUAGES`` languages has a fixed size
  and is broadcast, so pages are scored where they are read; where there are more languages,
  pages are read once for each such table. Trigrams of one page are no independent witnesses:
  beyond ``WITNESSES`` of them their sum counts as that of so many.
- The language the markup declares, the suffix of the address, and a language tag in
  the address (its first label or first folder). What such a value says about the language is
  counted from the text posteriors of the pages that have it, smoothed towards the whole web.
- A prior of the host, from grouped sums of text posteriors, smoothed towards the registered
  domain, which is smoothed towards the whole web.

A page's own posterior is left out of all sums that it is judged by, and pages that are
alike in address and markup are one page in them, so copies do not move an answer.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import written

#: Bins of the trigrams.
BUCKETS = 1 << 16
#: Trigrams of a page that count in full.
WITNESSES = 100
#: Pages for which what is smoothed towards counts, and for which the name of a language in markup or address counts.
SMOOTH, NAMED = 10.0, 2.0
#: Languages of one table of likelihoods (64 MB); beyond as many, sums over pages are taken language by language.
TABLE_LANGUAGES = 128

_LETTER = ts.ALNUM_WORD.copy()
_LETTER[0x30:0x3A] = False
# a tag begins with a letter, a slash or a mark; what is never closed reaches to the end
_SCRIPT = re.compile(r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*(?:>|\Z)")
_HTML_TAG, _META_TAG = re.compile(r"<html\b[^>]*>", re.I), re.compile(r"<meta\b[^>]*>", re.I)
_LANG = re.compile(r"""\b(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,3})\b""", re.I)
_META = re.compile(r"""(?:http-equiv|name|property)\s*=\s*["']?(?:content-language|language|og:locale)\b""", re.I)
_CONTENT = re.compile(r"""\bcontent\s*=\s*["']?\s*([a-z]{2,3})(?![a-z])""", re.I)
_ADDRESS = re.compile(r"\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::\d+)?(?:/([^/?#]*))?", re.I)
_NAME = re.compile(r"([a-z]{2})(?:[-_][a-z]{2})?", re.I)


def page_text(page: str) -> str:
    """What a reader sees: without scripts, styles, comments and tags; entities are resolved."""
    return entities.unescape(_TAG.sub(" ", _SCRIPT.sub(" ", page)))


def declared(page: str) -> str | None:
    """The language that the markup declares: that of the html tag, else of a meta tag."""
    if tag := _HTML_TAG.search(page):
        if found := _LANG.search(tag[0]):
            return found[1].lower()
    for tag in _META_TAG.finditer(page):
        if _META.search(tag[0]) and (found := _CONTENT.search(tag[0])):
            return found[1].lower()
    return None


def address(url: str) -> tuple[str | None, str | None, str | None, str | None]:
    """Host, registered domain, suffix, and language tag of an address; null for what it lacks.

    The domain is the last two labels, or three where the last but one is short and the last a country (co.uk).
    """
    found = _ADDRESS.match(url)
    if not found:
        return None, None, None, None
    host = found[1].lower().strip(".")
    labels = host.split(".")
    if len(labels) < 2 or not re.fullmatch("[a-z]{2,24}|xn--[a-z0-9-]+", labels[-1]):
        return host or None, host or None, None, None
    n = 3 if len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3 else 2
    tag = next((t[1].lower() for t in map(_NAME.fullmatch, ([labels[0]] if len(labels) > n else []) + [found[2] or ""]) if t), None)
    return host, ".".join(labels[-n:]), labels[-1], tag


def _trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each trigram of letters, word ends as blanks, and the text of each."""
    raw = ts.LOWER[raw]
    starts, ends, first = ts.words(raw, offsets, _LETTER)
    size = ends - starts
    # all words with one blank before each, and one at the end
    at = np.concatenate(([0], np.cumsum(size + 1)))
    line = np.full(at[-1] + 1, 32, np.uint8)
    line[np.arange(size.sum()) + np.repeat(at[:-1] + 1 - (np.cumsum(size) - size), size)] = raw[np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)]
    wide = line.astype(np.uint64)
    grams = wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]
    owner = np.repeat(ts.owners(first), size + 1)
    # those with the blank in the middle belong to no word
    inside = line[1:-1] != 32
    return (ts.mix(grams[inside]) % np.uint64(BUCKETS)).astype(np.int64), owner[: len(grams)][inside]


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bin, n) over a task."""
    held: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, np.flatnonzero(n), n[n > 0]) for lang, n in held.items()]
        held.clear()
        langs = [x for lang, at, _ in rows for x in [lang] * len(at)]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([r[1] for r in rows]).astype(np.int32)), pa.array(np.concatenate([r[2] for r in rows]))], names=["lang", "bin", "n"])

    for piece in ts.pieces(batches):
        bins, of = _trigrams(*ts.flat(piece.column("text")))
        langs = piece.column("lang").dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            held.setdefault(lang, np.zeros(BUCKETS, np.int64))
            held[lang] += np.bincount(bins[code[of] == k], minlength=BUCKETS)
        if len(held) > 64:
            yield out()
    if held:
        yield out()


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bins, ns, total) of ``docs`` (text, lang): one row a language, with at most ``BUCKETS`` bins."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.trim(F.col("lang").cast("string")).alias("lang")).where("lang <> ''")
    counts = rows.mapInArrow(_count_task, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    # a language whose documents have no trigram counts too
    gathered = counts.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("all"))
    known = rows.select("lang").distinct().join(gathered, "lang", "left")
    return written(known.select("lang", F.coalesce("all.bin", F.array().cast("array<int>")).alias("bins"), F.coalesce("all.n", F.array().cast("array<long>")).alias("ns")), "lang-trigrams")


def likelihoods(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """ln P(bin | language), by bin, of at most ``TABLE_LANGUAGES`` languages."""
    table = np.ones((BUCKETS, len(langs)))
    found = counts.where(F.col("lang").isin(langs)).toArrow()
    place = {lang: k for k, lang in enumerate(langs)}
    for lang, bins, ns in zip(found.column("lang").to_pylist(), found.column("bins"), found.column("ns"), strict=True):
        table[bins.values.to_numpy(), place[lang]] += ns.values.to_numpy()
    return np.log(table / table.sum(0, keepdims=True))


#: Values that pages share.
KINDS = ("host", "domain", "suffix", "tag", "declared")


def _posterior(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _array(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))


def _read_task(model):
    """From (page, url, html): the address, what is declared, and ln of the text's likelihoods."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for piece in ts.pieces(batches, "html"):
            pages = [x or "" for x in piece.column("html").to_pylist()]
            bins, of = _trigrams(*ts.flat(pa.array([page_text(x) for x in pages], pa.string())))
            n = np.bincount(of, minlength=len(pages))
            logs = np.stack([np.bincount(of, table[bins, k], minlength=len(pages)) for k in range(table.shape[1])], axis=1).astype(float)
            logs *= (np.minimum(n, WITNESSES) / np.maximum(n, 1))[:, None]
            places = [address(u or "") for u in piece.column("url").to_pylist()]
            words = [pa.array([p[k] for p in places], pa.string()) for k in range(4)]
            arrays = [piece.column("page"), *words, pa.array([declared(x) for x in pages], pa.string()), _array(logs)]
            yield pa.RecordBatch.from_arrays(arrays, names=["page", *KINDS, "logs"])

    return read


def _posterior_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            logs = batch.column("logs").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield batch.append_column("p", _array(_posterior(logs)))


def page_evidence(rows: DataFrame, counts: DataFrame, langs: list[str]) -> DataFrame:
    """(page, what pages share, logs, p) of each page (page, url, html), logs and p in the order of ``langs``. One table of likelihoods is held at a time."""
    strings = ", ".join(f"{kind} string" for kind in KINDS)
    blocks = []
    for k in range(0, len(langs), TABLE_LANGUAGES):
        model = rows.sparkSession.sparkContext.broadcast(likelihoods(counts, langs[k : k + TABLE_LANGUAGES]))
        read = rows.mapInArrow(_read_task(model), f"page long, {strings}, logs array<double>")
        blocks.append(written(read.groupBy("page").agg(*[F.first(c).alias(c) for c in (*KINDS, "logs")]), "page-logs"))
        model.unpersist()
    each = blocks[0]
    for other in blocks[1:]:
        each = each.join(other.select(F.col("page").alias("q"), F.col("logs").alias("more")), F.col("page") == F.col("q")).select("page", *KINDS, F.concat("logs", "more").alias("logs"))
    return written(each.mapInArrow(_posterior_task, f"page long, {strings}, logs array<double>, p array<double>"), "page-evidence")


def posterior_sums(rows: DataFrame, keys: list[str], n_langs: int) -> DataFrame:
    """(keys, n, sums): rows and the sums of their ``p``, by language, of each value of ``keys``."""
    if n_langs <= TABLE_LANGUAGES:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("p")[k]) for k in range(n_langs)]).alias("sums"))
    long = rows.select(*keys, F.posexplode("p").alias("k", "x")).groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))
    return long.groupBy(*keys).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "x"))).alias("all")).select(*keys, "n", F.col("all.x").alias("sums"))


def fuse(langs: list[str], logs: np.ndarray, own: np.ndarray, web: tuple[float, np.ndarray], met: dict[str, tuple[list, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Posterior of each page. ``met`` has for each kind the values, and the pages that have them and their sums of text posteriors.

    All sums hold the page itself, which is taken out.
    """
    every = (web[1] - own + 1) / (web[0] - 1 + len(langs))

    def towards(kind: str, base: np.ndarray) -> np.ndarray:
        values, n, sums = met[kind]
        # a value that names a language counts as some pages of it
        named = NAMED * np.array([[v == lang for lang in langs] for v in values]) if kind in ("tag", "declared") else 0.0
        share = np.where((n > 0)[:, None], sums - own, 0.0) + named + SMOOTH * base
        return share / share.sum(1, keepdims=True)

    prior = towards("host", towards("domain", every))
    said = sum(np.log(towards(kind, every) / every) for kind in ("suffix", "tag", "declared"))
    return _posterior(logs + said + np.log(prior))


def _fuse_task(langs: list[str], web: tuple[float, np.ndarray]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = lambda column: column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs))
        for batch in batches:
            if not batch.num_rows:
                continue
            met = {}
            for kind in KINDS:
                sums = batch.column(f"{kind}_sums")
                met[kind] = (batch.column(kind).to_pylist(), batch.column(f"{kind}_n").fill_null(0).to_numpy(), matrix(sums))
            p = fuse(langs, matrix(batch.column("logs")), matrix(batch.column("p")), web, met)
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array([langs[k] for k in best], pa.string()), pa.array(p.max(1))], names=["page", "lang", "probability"])

    return task


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, probability) of every row of ``pages`` (page_id, url, html), learned from ``docs`` (text, lang).

    Null or empty html has no text and declares nothing, a null url or one without a host has no prior of
    its own; then the rest decides, at last the whole web. Of equally likely languages the first by name is taken.
    Rows alike in url and html have one answer, whatever their page_id and number. Texts of any length
    count as ``WITNESSES`` trigrams at most. Documents without lang are not read; without any training row
    lang is null and probability 0. Languages may be as many as the driver can name. Other columns are not read.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("page", F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))))
    counts = trigram_counts(docs)
    langs = sorted(r["lang"] for r in counts.select("lang").collect())
    if not langs:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"))
    each = page_evidence(rows.select("page", "url", "html"), counts, langs)
    world = posterior_sums(each, [], len(langs)).first()
    if not world or not world["n"]:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"))
    web = (float(world["n"]), np.array(world["sums"], float))
    # every value that two pages share, of all kinds, in one grouped sum
    values = each.select("page", "p", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KINDS])).alias("v")).where("v.value is not null").select("page", "p", "v.kind", "v.value")
    sums = posterior_sums(values, ["kind", "value"], len(langs)).where("n > 1")
    # a table of its own: the join then has an exchange on either side, and a value that very many pages have can be split
    sums = written(sums.withColumnsRenamed({"kind": "k", "value": "v"}), "page-sums")
    found = values.join(sums, (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v"))).select("page", "kind", F.struct("n", "sums").alias("s"))
    found = found.groupBy("page").pivot("kind", list(KINDS)).agg(F.first("s"))
    none = F.array_repeat(F.lit(0.0), len(langs))
    got = each.join(found.select(F.col("page").alias("q"), *[F.col(k).alias(f"of_{k}") for k in KINDS]), F.col("page") == F.col("q"), "left")
    got = got.select("page", *KINDS, "logs", "p", *[F.col(f"of_{k}.n").alias(f"{k}_n") for k in KINDS], *[F.coalesce(F.col(f"of_{k}.sums"), none).alias(f"{k}_sums") for k in KINDS])
    answers = written(got.mapInArrow(_fuse_task(langs, web), "page long, lang string, probability double").withColumnRenamed("page", "q"), "page-languages")
    return rows.select("page_id", "page").join(answers, F.col("page") == F.col("q")).select("page_id", "lang", "probability")
