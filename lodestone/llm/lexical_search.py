"""Ranked lexical search over an index of clusters, with exact stopping.

Index. Documents are put into an order in which neighbours share terms, by recursive graph bisection of the graph of documents and
terms: the two halves of a part exchange documents as long as this makes the gaps between documents of a term smaller.

1. The first ``DEPTH`` levels are fitted to a bounded sample (``SAMPLE_DOCS`` documents, ``SAMPLE_TERMS`` terms of each, by hash). Each of their
   parts keeps what a term says for either half, so every document finds its way to a leaf by its own terms.
2. All documents are dealt by leaf; a leaf with many documents is dealt to several tasks. In a task they are cut into blocks of ``BLOCK_BYTES``,
   and a block is bisected further, on all its terms, down to shards of ``SHARD_DOCS`` documents. A shard is a row of the
   index: its documents, their lengths, and for each term the documents that hold it and how often.

Search. The frequencies of the queries' terms are added up over the shards. In each shard, the largest part of a score that each
term has anywhere gives a bound for each query. The shards with the highest bounds of a query are visited first; their scores
give a threshold. All other shards are visited by their bounds, and only where the bound reaches the threshold or the last of the best
that a task has found: what is left out can't be among the best. Ties go by doc_id, whatever the order of the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import written

#: The bounded sample that the first levels are fitted to, and how many levels; terms that it has twice at least count, the most frequent first.
SAMPLE_DOCS, SAMPLE_TERMS, SAMPLE_WORDS = 4096, 256, 1 << 16
DEPTH = 6
#: Bytes of a leaf that are dealt together, of a block that is bisected at once, and documents of a shard.
LEAF_BYTES, BLOCK_BYTES, SHARD_DOCS = 1 << 20, 4 << 20, 64
#: Exchanges between two halves at most.
ROUNDS = 8
#: Shards that are looked at together, by their bounds.
VISIT_SHARDS = 32
#: Queries that are searched at once; what is broadcast and collected is bounded by them.
BLOCK_QUERIES = 1024
#: Shards that a query visits before it has a threshold.
FIRST_SHARDS = 2
BEST = 10
#: Stands for rows without doc_id, which come last among equals.
NO_ID = np.iinfo(np.int64).max


def doc_terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, term (a hash) and count of each distinct term of each text, by document and term; and terms with repeats of each text."""
    raw = ts.LOWER[raw]
    starts, ends, first = ts.words(raw, offsets, ts.ALNUM_WORD)
    hashes, owner = ts.span_hashes(ts.prefix_hashes(raw), starts, ends), ts.owners(first)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(hashes))), np.diff(first)


def halves(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, rounds: int = ROUNDS) -> np.ndarray:
    """Which documents go to the first half: as many as to the second, or one fewer. They begin in the order of the least term that they have."""
    least = np.full(n_docs, n_terms)
    np.minimum.at(least, doc, term)
    left = np.zeros(n_docs, bool)
    left[np.argsort(least, kind="stable")[: n_docs // 2]] = True
    degree = np.bincount(term, minlength=n_terms).astype(float)
    gap = lambda d, n: d * np.log2(n / (d + 1))
    n_left = float(left.sum())
    n_right = n_docs - n_left
    for _ in range(rounds):
        on = left[doc]
        one = np.bincount(term, on, minlength=n_terms)
        other = degree - one
        now = gap(one, n_left) + gap(other, n_right)
        # what a document's move saves in this term
        to_right = now - gap(np.maximum(one - 1, 0), n_left) - gap(other + 1, n_right)
        to_left = now - gap(one + 1, n_left) - gap(np.maximum(other - 1, 0), n_right)
        gain = np.bincount(doc, np.where(on, to_right[term], to_left[term]), minlength=n_docs)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b))
        swap = int((gain[a[:n]] + gain[b[:n]] > 1e-9).sum())
        if not swap:
            break
        left[a[:swap]], left[b[:swap]] = False, True
    return left


def ordered(doc: np.ndarray, term: np.ndarray, n_docs: int, most: int = SHARD_DOCS) -> list[np.ndarray]:
    """Documents in parts of ``most`` at most, in the order of the bisection."""
    if n_docs <= most:
        return [np.arange(n_docs)]
    # a term of one document doesn't say where it goes
    term = np.unique(term, return_inverse=True)[1]
    several = np.bincount(term) > 1
    keep = several[term]
    doc, term = doc[keep], (np.cumsum(several) - 1)[term[keep]]
    left = halves(doc, term, n_docs, int(several.sum()))
    parts = []
    for side in (left, ~left):
        own, name = side[doc], np.cumsum(side) - 1
        parts += [np.flatnonzero(side)[p] for p in ordered(name[doc[own]], term[own], int(side.sum()), most)]
    return parts


@dataclass
class Tree:
    """The first levels: the terms (sorted hashes), what each says for the first half of each part, and the middle of each part."""

    terms: np.ndarray
    says: np.ndarray
    middle: np.ndarray

    def leaves(self, doc: np.ndarray, term: np.ndarray, n_docs: int) -> np.ndarray:
        """The leaf of each document, from its distinct terms."""
        at = np.zeros(n_docs, np.int64)
        if not len(self.terms):
            return at
        place = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[place] == term
        doc, place = doc[known], place[known]
        count = np.maximum(1, np.bincount(doc, minlength=n_docs))
        for level in range(DEPTH):
            part = (1 << level) - 1 + at
            score = np.bincount(doc, self.says[part[doc], place], minlength=n_docs) / count
            at = 2 * at + (score < self.middle[part])
        return at


def fitted(sample: list[np.ndarray]) -> Tree:
    """The tree of a sample: the distinct terms of each document."""
    doc = np.repeat(np.arange(len(sample)), [len(s) for s in sample])
    flat = np.concatenate([*sample, np.zeros(0, np.uint64)]).astype(np.uint64)
    terms, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    chosen = np.sort(np.argsort(-count, kind="stable")[: min(SAMPLE_WORDS, int((count > 1).sum()))])
    name = np.full(len(terms), -1)
    name[chosen] = np.arange(len(chosen))
    term = name[inverse]
    doc, term = doc[term >= 0], term[term >= 0]
    says, middle = np.zeros(((1 << DEPTH) - 1, len(chosen)), np.float32), np.zeros((1 << DEPTH) - 1)
    members = {0: np.arange(len(sample))}
    for part in range((1 << DEPTH) - 1):
        own = members.pop(part, np.zeros(0, int))
        if len(own) < 2:
            continue
        inside = np.full(len(sample), -1)
        inside[own] = np.arange(len(own))
        mine = inside[doc] >= 0
        d, t = inside[doc[mine]], term[mine]
        left = halves(d, t, len(own), len(chosen))
        one, both = np.bincount(t, left[d], minlength=len(chosen)), np.bincount(t, minlength=len(chosen))
        says[part] = np.log2((one + 0.5) / (left.sum() + 1)) - np.log2((both - one + 0.5) / ((~left).sum() + 1))
        score = np.bincount(d, says[part][t], minlength=len(own)) / np.maximum(1, np.bincount(d, minlength=len(own)))
        middle[part] = np.median(score)
        members[2 * part + 1], members[2 * part + 2] = own[score >= middle[part]], own[score < middle[part]]
    return Tree(terms[chosen], says, middle)


def _few(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Which (document, term), in order, are among the first ``SAMPLE_TERMS`` terms of their document by hash: those that the first levels look at."""
    upto = np.searchsorted(doc, np.arange(n_docs + 1))
    return np.arange(len(doc)) - upto[doc] < SAMPLE_TERMS


def _sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in ts.pieces(batches):
        raw, offsets = ts.flat(piece.column("text"))
        doc, term, _, _ = doc_terms(raw, offsets)
        few = _few(doc, piece.num_rows)
        doc, term = doc[few], term[few]
        at = pa.array(np.searchsorted(doc, np.arange(piece.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([piece.column("key"), pa.ListArray.from_arrays(at, pa.array(term.view(np.int64))), pa.array(np.diff(offsets))], names=["key", "terms", "size"])


def _leaf_task(tree, subs):
    """Adds leaf and sub to (doc_id, text): leaves with many documents are dealt in turn."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() * 7919
        for piece in ts.pieces(batches):
            raw, offsets = ts.flat(piece.column("text"))
            doc, term, _, _ = doc_terms(raw, offsets)
            few = _few(doc, piece.num_rows)
            leaf = tree.value.leaves(doc[few], term[few], piece.num_rows)
            turn = (np.arange(piece.num_rows) + seen) % subs.value[leaf]
            seen += piece.num_rows
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text"), pa.array(leaf.astype(np.int32)), pa.array(turn.astype(np.int32))], names=["doc_id", "text", "leaf", "sub"])

    return route


_SHARD = "shard long, doc_ids array<long>, sizes array<int>, terms binary, first binary, docs binary, counts binary"


def _shard_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of texts that come by leaf."""
    number = TaskContext.get().partitionId() << 33
    waiting: list[pa.RecordBatch] = []
    held, leaf = 0, None

    def shards() -> pa.RecordBatch:
        nonlocal number
        table = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        parts = [doc_terms(*ts.flat(p.column("text"))) for p in ts.pieces(iter([table]))]
        base = np.cumsum([0, *[len(p[3]) for p in parts]])
        doc = np.concatenate([p[0] + b for p, b in zip(parts, base, strict=False)])
        term, count, size = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        # texts without terms are in no shard
        some = np.flatnonzero(size > 0)
        name = np.full(len(size), -1)
        name[some] = np.arange(len(some))
        doc = name[doc]
        upto = np.searchsorted(doc, np.arange(len(some) + 1))
        rows = []
        for part in ordered(doc, term, len(some)) if len(some) else []:
            edges = np.concatenate([np.arange(upto[d], upto[d + 1]) for d in part])
            of = np.repeat(np.arange(len(part)), upto[part + 1] - upto[part])
            order = np.argsort(term[edges], kind="stable")
            words, first = np.unique(term[edges][order], return_index=True)
            binary = [words.astype("<u8"), first.astype("<u4"), of[order].astype("<u2"), count[edges][order].astype("<u4")]
            rows.append((number, pa.array(some[part]), size[some[part]], *[b.tobytes() for b in binary]))
            number += 1
        ids = [table.column("doc_id").take(r[1]).to_pylist() for r in rows]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 4)
        columns = [[r[0] for r in rows], ids, [r[2] for r in rows], *[[r[k] for r in rows] for k in range(3, 7)]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _SHARD.split(", ")])

    for batch in batches:
        for piece in ts.pieces(iter([batch]), limit=BLOCK_BYTES // 4):
            of = piece.column("leaf").to_numpy()
            for a, b in _stretches(of):
                if waiting and (of[a] != leaf or held > BLOCK_BYTES):
                    yield shards()
                    waiting, held = [], 0
                leaf = of[a]
                waiting.append(piece.slice(a, b - a))
                held += int(ts.flat(waiting[-1].column("text"))[1][-1])
    if waiting:
        yield shards()


def _stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    at = np.flatnonzero(np.diff(values, prepend=values[0] - 1)) if len(values) else []
    return list(zip(at, [*at[1:], len(values)], strict=True)) if len(values) else []


def index(docs: DataFrame) -> DataFrame:
    """The index of (doc_id, text): a written table of shards. Documents without a term, and null texts, are in none; repeated rows are documents each.

    Rows without doc_id are indexed too. Texts are read whole. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    key = F.xxhash64(F.lit(12), "doc_id")
    share = min(1.0, 4 * SAMPLE_DOCS / max(1, n))
    picked = docs.where(F.pmod(key, F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select(key.alias("key"), "text").mapInArrow(_sample_task, "key long, terms array<long>, size long")
    rows = picked.orderBy("key", F.xxhash64("terms")).limit(SAMPLE_DOCS).collect()
    sample = [np.array(r.terms, np.int64).view(np.uint64) for r in rows]
    tree = fitted(sample)
    doc = np.repeat(np.arange(len(sample)), [len(s) for s in sample])
    leaves = tree.leaves(doc, np.concatenate([*sample, np.zeros(0, np.uint64)]).astype(np.uint64), len(sample))
    # a leaf's share of the sample's bytes tells in how many it is dealt
    shares = np.bincount(leaves, [r.size for r in rows], minlength=1 << DEPTH) / max(1, sum(r.size for r in rows))
    subs = np.maximum(1, np.ceil(shares * size / LEAF_BYTES)).astype(np.int64)
    routed = docs.mapInArrow(_leaf_task(spark.sparkContext.broadcast(tree), spark.sparkContext.broadcast(subs)), "doc_id long, text string, leaf int, sub int")
    dealt = routed.repartition("leaf", "sub").sortWithinPartitions("leaf", "sub").select("doc_id", "text", "leaf")
    return written(dealt.mapInArrow(_shard_task, _SHARD), "lexical-index")


class Shard:
    """A row of the index, for the terms of a block of queries."""

    def __init__(self, batch: pa.RecordBatch, i: int, wanted: np.ndarray) -> None:
        get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
        self.number = batch.column("shard")[i].as_py()
        ids, sizes = batch.column("doc_ids")[i].values, batch.column("sizes")[i].values
        self.ids = ids.fill_null(NO_ID).to_numpy()
        self.sizes = sizes.to_numpy().astype(np.int64)
        terms, first = get("terms", "<u8"), get("first", "<u4").astype(np.int64)
        docs = get("docs", "<u2")
        at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        self.found = np.flatnonzero(terms[at] == wanted)
        at, stop = at[self.found], np.append(first, len(docs))
        self.df = stop[at + 1] - first[at]
        self.begin = np.cumsum(self.df) - self.df
        take = np.repeat(first[at] - self.begin, self.df) + np.arange(self.df.sum())
        self.docs, self.counts = docs[take].astype(np.int64), get("counts", "<u4")[take].astype(np.int64)

    def parts(self, n: int, length: int) -> np.ndarray:
        """What each place of a term adds to a score, but for the term's weight."""
        sizes, of = np.unique(self.sizes, return_inverse=True)
        # whole numbers of any size
        m = np.array([10 + 90 * int(s) * n // length for s in sizes.tolist()], np.int64)[of]
        return 1_000_000_000 * self.counts // (1000 * self.counts + 8 * m[self.docs])


@dataclass
class Queries:
    """A block of queries: the distinct terms (sorted hashes), and of each query, one after another, the places of its terms among them."""

    terms: np.ndarray
    flat: np.ndarray
    first: np.ndarray
    weights: np.ndarray | None = None
    n: int = 0
    length: int = 0

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over the terms of each query of a row of values a term; every query has a term."""
        return np.add.reduceat(values[self.flat], self.first, axis=0)


def _shards(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard(batch, i, wanted)
            if len(shard.found):
                yield shard


def _frequency_task(queries):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(term, df) of the terms found in a task, and, as -1 and -2, its documents and the sum of their lengths."""
        q = queries.value
        df, n, length = np.zeros(len(q.terms), np.int64), 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch, i, q.terms)
                df[shard.found] += shard.df
                n, length = n + len(shard.sizes), length + int(shard.sizes.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1, -2], pa.int64()), pa.array([*df[at], n, length], pa.int64())], names=["term", "df"])

    return count


def _bounds(shard: Shard, q: Queries, parts: np.ndarray) -> np.ndarray:
    """What no document of the shard exceeds, for each query."""
    most = np.zeros(len(q.terms), np.int64)
    most[shard.found] = np.maximum.reduceat(parts, shard.begin) * q.weights[shard.found]
    return q.sums(most)


def _first_task(queries):
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query, shard, bound): the highest bounds of each query in a task."""
        q = queries.value
        top = np.zeros((len(q.first), FIRST_SHARDS + 1), np.int64)
        names = np.full(top.shape, -1, np.int64)
        for shard in _shards(batches, q.terms):
            top[:, -1], names[:, -1] = _bounds(shard, q, shard.parts(q.n, q.length)), shard.number
            order = np.lexsort((names, -top), axis=1)
            top, names = np.take_along_axis(top, order, 1), np.take_along_axis(names, order, 1)
        query, at = np.nonzero(top[:, :FIRST_SHARDS])
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(names[query, at]), pa.array(top[query, at])], names=["query", "shard", "bound"])

    return first


def _visit_task(queries, threshold, k: int):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query, doc_id, score): the best of each query in a task."""
        q, least = queries.value, threshold.value
        best, names = np.zeros((len(q.first), k), np.int64), np.full((len(q.first), k), NO_ID)
        for batch in (b.slice(a, VISIT_SHARDS) for b in batches for a in range(0, b.num_rows, VISIT_SHARDS)):
            shards = [(s, p, _bounds(s, q, p)) for s in _shards(iter([batch]), q.terms) for p in [s.parts(q.n, q.length)]]
            for shard, parts, bound in sorted(shards, key=lambda s: -int(s[2].max())):
                worst = np.maximum(best[:, -1], least)
                ask = np.flatnonzero((bound > 0) & (bound >= worst))
                if not len(ask):
                    continue
                adds = np.zeros((len(q.terms), len(shard.ids)), np.int64)
                adds[np.repeat(shard.found, shard.df), shard.docs] = parts * np.repeat(q.weights[shard.found], shard.df)
                size = np.diff(np.append(q.first, len(q.flat)))[ask]
                places = np.repeat(q.first[ask] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                score = np.add.reduceat(adds[q.flat[places]], np.cumsum(size) - size, axis=0)
                hit = np.flatnonzero(score.max(1) >= np.maximum(worst[ask], 1))
                ask, score = ask[hit], score[hit]
                all_scores = np.hstack((best[ask], score))
                all_names = np.hstack((names[ask], np.broadcast_to(shard.ids, score.shape)))
                order = np.lexsort((all_names, -all_scores), axis=1)[:, :k]
                best[ask], names[ask] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_names, order, 1)
        query, at = np.nonzero((best > 0) & (best >= least[:, None]))
        ids = names[query, at]
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, mask=ids == NO_ID), pa.array(best[query, at])], names=["query", "doc_id", "score"])

    return visit


def _term_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in ts.pieces(batches):
        raw, offsets = ts.flat(piece.column("text"))
        doc, term, _, _ = doc_terms(raw, offsets)
        at = pa.array(np.searchsorted(doc, np.arange(piece.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([piece.column("item_id"), pa.ListArray.from_arrays(at, pa.array(term.view(np.int64)))], names=["item_id", "terms"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(shards: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of an ``index`` for each of (item_id, text).

    Scores and their order are those of the contract: whole numbers, equal ones by ascending doc_id, and then rows without doc_id. Rows with one
    item_id (null is one too) are one query of all their terms. Items without terms, and null ones, have no rows; nor has any item if
    the index is empty. Terms are compared by 64-bit hash. Queries go in blocks of ``BLOCK_QUERIES``, each of which reads the index four times.
    """
    spark = shards.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    terms = written(rows.mapInArrow(_term_task, "item_id long, terms array<long>"), "query-terms")
    blocks = max(1, -(-terms.count() // BLOCK_QUERIES))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for i in range(blocks):
        own: dict[int | None, set[int]] = {}
        for r in terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect():
            own.setdefault(r.item_id, set()).update(r.terms)
        own = {name: found for name, found in own.items() if found}
        if own:
            out = out.unionByName(_block(shards, own, k))
    return out


def _block(shards: DataFrame, own: dict[int | None, set[int]], k: int) -> DataFrame:
    """The best of a block of queries; the first of them are looked for at once, the rest when the result is read."""
    spark = shards.sparkSession
    context = spark.sparkContext
    sizes = [len(found) for found in own.values()]
    flat = np.array([t for found in own.values() for t in sorted(found)], np.int64).view(np.uint64)
    distinct, place = np.unique(flat, return_inverse=True)
    queries = Queries(distinct, place, np.cumsum(sizes) - sizes)
    counted = shards.mapInArrow(_frequency_task(context.broadcast(queries)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = {r.term: r.df for r in counted.collect()}
    queries.n, queries.length = df.get(-1, 0), max(1, df.get(-2, 0))
    queries.weights = np.array([math.floor(1000 * math.log((2 * queries.n + 2) / (2 * df.get(j, 0) + 1))) for j in range(len(distinct))], np.int64)
    asked = context.broadcast(queries)
    bounds = shards.mapInArrow(_first_task(asked), "query long, shard long, bound long")
    first = Window.partitionBy("query").orderBy(F.desc("bound"), "shard")
    seeds = {r.shard for r in bounds.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= FIRST_SHARDS).select("shard").distinct().collect()}
    threshold = np.zeros(len(own), np.int64)
    kind = "query long, doc_id long, score long"
    tried = shards.where(F.col("shard").isin(sorted(seeds))).mapInArrow(_visit_task(asked, context.broadcast(threshold), k), kind)
    for r in _ranked(tried, k).where(F.col("rank") == k).collect():
        threshold[r.query] = r.score
    found = shards.mapInArrow(_visit_task(asked, context.broadcast(threshold), k), kind)
    names = spark.createDataFrame(list(enumerate(own)), "query long, item_id long")
    return _ranked(found, k).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
