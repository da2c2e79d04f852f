"""Exact cosine search: Column expressions for single values, block products for batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bm25 import top

#: Digits of a cosine that is ranked.
DIGITS = 6
#: Queries in one broadcast; more are taken block by block.
BLOCK_QUERIES = 4096
#: Scores in one product: that of few rows where there are many queries.
BLOCK_SCORES = 1 << 22


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null where lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms == 0, 0.0).otherwise(dot(a, b) / F.when(norms != 0, norms)))


def _best(ids: np.ndarray, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row: ``score`` in whole units, of the ids that ``at`` points to, ties by id."""
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    # one number for both, so that a partition is enough
    order = (-score << 32) | rank[at]
    return np.argpartition(order, k - 1, axis=1)[:, :k] if order.shape[1] > k else np.broadcast_to(np.arange(order.shape[1]), order.shape)


def _block_task(block, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best rows of each query in this task: what leaves it does not grow with the corpus."""
        queries = block.value
        ids, at, score, kind = None, None, None, None
        step = max(1, BLOCK_SCORES // len(queries))
        for batch in batches:
            kind = batch.schema.field("id").type
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                rows = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)
                norm = np.linalg.norm(rows, axis=1)
                rows = np.divide(rows, norm[:, None], out=np.zeros_like(rows), where=norm[:, None] > 0)
                new = np.rint((queries @ rows.T) * 10**DIGITS).astype(np.int64)
                names = part.column("id").to_numpy(zero_copy_only=False)
                take = _best(names, np.arange(len(names))[None, :], new, k)
                new = np.take_along_axis(new, take, 1)
                if ids is None:
                    ids, at, score = names, take, new
                    continue
                at, score = np.hstack((at, take + len(ids))), np.hstack((score, new))
                ids = np.concatenate((ids, names))
                take = _best(ids, at, score, k)
                at, score = np.take_along_axis(at, take, 1), np.take_along_axis(score, take, 1)
                used, at = np.unique(at, return_inverse=True)
                ids, at = ids[used], at.reshape(take.shape)
        if ids is not None and at.shape[1]:
            who = np.repeat(np.arange(len(queries)), at.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), pa.array(ids[at.ravel()].tolist(), kind), pa.array(score.ravel() / 10**DIGITS)], names=["q", "id", "score"])

    return search


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k nearest of (id, embedding) to each of (qid, embedding), ties by id.

    Queries are compared with rows of their own dimension; null ones have no hits. A
    zero vector has cosine 0 with all. Queries go in blocks of a fixed number.
    """
    spark = vectors.sparkSession
    qid_type = queries.schema["qid"].dataType.simpleString()
    id_type = vectors.schema["id"].dataType.simpleString()
    found = spark.createDataFrame([], f"qid {qid_type}, id {id_type}, score double")
    wanted = queries.where("embedding is not null").select("qid", F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = wanted.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect() if k > 0 else []
    for dim, n in sizes:
        usable = vectors.where((F.size("embedding") == dim) & F.col("id").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        n_blocks = -(-n // BLOCK_QUERIES)
        for i in range(n_blocks):
            rows = wanted.where((F.size("embedding") == dim) & (F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == i)).collect()
            if not rows:
                continue
            matrix = np.array([r["embedding"] for r in rows]).reshape(len(rows), -1)
            norm = np.linalg.norm(matrix, axis=1)
            matrix = np.divide(matrix, norm[:, None], out=np.zeros_like(matrix), where=norm[:, None] > 0)
            names = spark.createDataFrame([(j, r["qid"]) for j, r in enumerate(rows)], f"q int, qid {qid_type}")
            part = usable.mapInArrow(_block_task(spark.sparkContext.broadcast(matrix), k), f"q int, id {id_type}, score double").join(F.broadcast(names), "q").select("qid", "id", "score")
            found = found.unionByName(part)
    return top(found, k)
