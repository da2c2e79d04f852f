"""BM25, cosine and hybrid search against plain models and on edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, hybrid, vector


def records(spark, docs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, bm25_tokens array<string>")


def scored(spark, docs, query, **options):
    df = records(spark, docs)
    tokens = spark.createDataFrame([(0, t) for t in query], "qid int, token string")
    return {r.id: r.score for r in bm25.scores(bm25.postings(df), bm25.corpus_stats(df), tokens, **options).collect()}


def model(docs, query, k1=1.5, b=0.75):
    n, avg, out = len(docs), sum(map(len, docs)) / len(docs), {}
    for t in query:
        df = sum(t in d for d in docs)
        for i, d in enumerate(docs):
            if tf := d.count(t):
                out[i] = out.get(i, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avg))
    return {i: round(s, 9) for i, s in out.items()}


def test_bm25(spark):
    docs = [["rust", "fast"], ["python", "slow", "easy"], ["rust", "rust", "rust", "memory"], [], ["other"]]
    assert scored(spark, docs, ["rust", "easy", "nothing"]) == pytest.approx(model(docs, ["rust", "easy"]))
    assert scored(spark, docs, ["nothing"]) == {}
    assert scored(spark, docs, ["rust"], k1=1.2) == pytest.approx(model(docs, ["rust"], k1=1.2))


def test_bm25_ties_and_limits(spark):
    df = records(spark, [["a1x"]] * 7)
    tokens = spark.createDataFrame([(0, "a1x")], "qid int, token string")
    best = bm25.top(bm25.scores(bm25.postings(df), bm25.corpus_stats(df), tokens), 3).collect()
    assert [(r.id, r["rank"]) for r in sorted(best, key=lambda r: r["rank"])] == [(0, 1), (1, 2), (2, 3)]
    empty = records(spark, [])
    assert bm25.corpus_stats(empty).first() == (0, 0.0)
    assert bm25.scores(bm25.postings(empty), bm25.corpus_stats(empty), tokens).count() == 0


def test_cosine(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0]), (3, [3.0, 3.0]), (4, [1.0]), (5, None), (6, [2.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0])], "qid string, embedding array<float>")
    hits = {}
    for r in vector.search(vectors, queries, 4).orderBy("qid", "rank").collect():
        hits.setdefault(r.qid, []).append((r.id, r.score))
    assert hits["q"] == [(0, 1.0), (6, 1.0), (3, 0.707107), (1, 0.0)]
    assert hits["z"] == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]
    q = F.array(F.lit(1.0), F.lit(0.0))
    got = {r.id: r.c for r in vectors.select("id", F.round(vector.cosine(F.col("embedding"), q), 6).alias("c")).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.707107, 4: None, 5: None, 6: 1.0}
    assert vector.search(vectors, queries.limit(0), 3).count() == 0


def test_vector_batches_match_single_queries(spark, small, monkeypatch):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = vectors.where("id % 60 = 0").withColumnRenamed("id", "qid")
    whole = sorted(vector.search(vectors, queries, 7).collect())
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 3)
    assert sorted(vector.search(vectors, queries, 7).collect()) == whole


def arms(spark):
    ranked = lambda ids: spark.createDataFrame([(0, i, k + 1) for k, i in enumerate(ids)], "qid int, id long, rank int")
    return ranked([1, 2, 3]), ranked([3, 4])


@pytest.mark.parametrize("w", [0.0, 0.5, 1.0, 1.5])
def test_fusion(spark, w):
    v, t = arms(spark)
    want = {1: w / 61, 2: w / 62, 3: w / 63 + (1 - w) / 61, 4: (1 - w) / 62}
    got = [(r.id, r.score) for r in hybrid.hybrid(v, t, 10, w).orderBy("rank").collect()]
    assert dict(got) == pytest.approx(want, abs=1e-11)
    assert [i for i, _ in got] == sorted(want, key=lambda i: (-round(want[i], 12), i))


def test_filters_come_after_fusion(spark):
    v, t = arms(spark)
    few = spark.createDataFrame([(2,), (9,)], "id long")
    assert [r.id for r in hybrid.hybrid(v, t, 2, 0.5, few).collect()] == [2]
    assert hybrid.hybrid(v, t, 2, 0.5, few.where("id = 9")).count() == 0


def test_enrich_drops_unknown_hits(spark):
    v, t = arms(spark)
    records_ = spark.createDataFrame([(1, "one", None, "text", "{}", None), (3, "three", "f", "image", "{}", 30)], "id long, summary string, filename string, modality string, metadata string, parent_id long")
    payloads = spark.createDataFrame([(30,), (2,)], "payload_id long")
    shown = {r.id: (r.filename, r.has_payload) for r in hybrid.enrich(hybrid.hybrid(v, t, 5), records_, payloads).collect()}
    assert shown == {1: ("", False), 3: ("f", True)}


def test_queries_of_several_dimensions(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (None, [1.0, 1.0])], "id long, embedding array<float>")
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0, 0.0]), ("c", None), ("d", [1.0])], "qid string, embedding array<float>")
    got = {(r.qid, r.id): (r.score, r["rank"]) for r in vector.search(rows, asked, 2).collect()}
    assert got == {("a", 1): (1.0, 1), ("a", 2): (0.0, 2), ("b", 3): (0.0, 1)}
    assert vector.search(rows, asked, 0).count() == 0 and vector.search(rows, asked.limit(0), 3).count() == 0
