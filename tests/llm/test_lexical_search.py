"""Ranked search against a plain model of the contract, and the bisection that orders documents."""

import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import corpus as C  # noqa: E402

from lodestone.llm import lexical_search as L  # noqa: E402
from lodestone.llm import queries  # noqa: E402


def terms(text):
    return C.ALNUM.findall((text or "").translate(C.LOWER))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) of (doc_id, text) rows."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, i is None, i, -score))
        out += [(item, r, i, -s) for r, (s, _, i, _) in enumerate(sorted(scored, key=lambda x: x[:2] + ((x[2] or 0),))[:k], 1)]
    return sorted(map(repr, out))


def rows(df):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_op12(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert rows(queries.op12_lexical_search(spark, small)) == brute(docs, items)


def test_awkward_tables(spark, monkeypatch):
    """Nulls, empty and long texts, many copies (ties), repeated rows, rows without id; items without id, terms or with several rows; small shards and blocks."""
    monkeypatch.setattr(L, "BLOCK_QUERIES", 5)
    docs = C.awkward(60) + [(1000 + i, "ten copies of one text") for i in range(150)] + [(3, "one two"), (3, "one two"), (None, "one two"), (None, None), (None, "lok")]
    items = [(i, t) for i, (_, t) in enumerate(C.awkward(12, 3))] + [(50, "one two"), (50, "copies"), (None, "ten copies"), (51, None), (52, ""), (53, "!!"), (54, "unknown"), (55, "X" * 60)]
    index = L.index(C.frame(spark, docs))
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    assert rows(L.search(index, asked)) == brute(docs, items)
    assert rows(L.search(index, asked, k=3)) == brute(docs, items, 3)
    sizes = [len(r.doc_ids) for r in index.collect()]
    assert max(sizes) <= L.SHARD_DOCS and sum(sizes) == sum(bool(terms(t)) for _, t in docs) and len({r.shard for r in index.collect()}) == len(sizes)
    empty = L.index(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and L.search(empty, asked).count() == 0 and L.search(index, asked.limit(0)).count() == 0


def test_bisection_brings_like_to_like():
    """Two vocabularies in turn: the halves are those of the vocabularies, and parts are of the size asked for."""
    rng = random.Random(1)
    docs = [[rng.randrange(50) + 100 * (i % 2) for _ in range(30)] for i in range(64)]
    doc = np.repeat(np.arange(64), [len(set(d)) for d in docs])
    term = np.concatenate([sorted(set(d)) for d in docs])
    left = L.halves(doc, term, 64, 150, rounds=20)
    assert left.sum() == 32 and len({i % 2 for i in np.flatnonzero(left)}) == 1
    parts = L.ordered(doc, term, 64, 10)
    assert sorted(np.concatenate(parts)) == list(range(64)) and max(map(len, parts)) <= 10 and all(len({i % 2 for i in p}) == 1 for p in parts)
    tree = L.fitted([np.unique(d).astype(np.uint64) for d in docs])
    leaves = tree.leaves(doc, term.astype(np.uint64), 64)
    assert len(set(leaves[::2]) & set(leaves[1::2])) == 0


def test_shards_out_of_reach_are_not_visited(spark, small, monkeypatch):
    """With a threshold, most shards are left out, and the result is the same."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    monkeypatch.setattr(L, "SHARD_DOCS", 4)
    shards = L.index(docs.coalesce(1))
    batches = shards.toArrow().to_batches()
    own = sorted({t for i, t in enumerate(next(iter(L._term_task(iter([L.pa.record_batch({"item_id": L.pa.array([1]), "text": L.pa.array([docs.first().text[:200]])})])))).column("terms")[0].as_py())})
    flat = np.array(own, np.int64).view(np.uint64)
    q = L.Queries(np.sort(flat), np.arange(len(flat)), np.array([0]), np.full(len(flat), 1000), 200, 60000)
    bound = {s.number: int(L._bounds(s, q, s.parts(q.n, q.length))[0]) for s in L._shards(iter(batches), q.terms)}

    class Held:
        def __init__(self, value):
            self.value = value

    best = [b for b in L._visit_task(Held(q), Held(np.zeros(1, np.int64)), 1)(iter(batches))][0].to_pylist()[0]
    assert max(bound.values()) >= best["score"] and sum(b >= best["score"] for b in bound.values()) < len(bound) / 2
