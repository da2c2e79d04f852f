"""Hybrid search: two ranked lists merged by weighted reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .bm25 import small, top

#: Added to ranks, so that the first places don't outweigh all others.
RRF_K = 60
#: Each list is cut at so many times the number of hits asked for.
OVER_FETCH = 4
DEFAULT_K, DEFAULT_WEIGHT = 5, 0.5
DIGITS = 12


def contributions(ranked: DataFrame, weight: float | Column) -> DataFrame:
    """(qid, id, part) from (qid, id, rank), ranks from 1."""
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    return ranked.select("qid", "id", (weight / (RRF_K + F.col("rank"))).alias("part"))


def fuse(vector_arm: DataFrame, text_arm: DataFrame, weight: float = DEFAULT_WEIGHT) -> DataFrame:
    """(qid, id, score): the arms' contributions added up; a weight outside 0 to 1 is taken as it is."""
    both = contributions(vector_arm, weight).unionByName(contributions(text_arm, 1.0 - weight))
    return both.groupBy("qid", "id").agg(F.round(F.sum("part"), DIGITS).alias("score"))


def hybrid(vector_arm: DataFrame, text_arm: DataFrame, k: int = DEFAULT_K, weight: float = DEFAULT_WEIGHT, candidates: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank) from arms that are cut at ``OVER_FETCH`` * k already.

    ``candidates`` (id) filters after fusion, so fewer than k hits may be left.
    """
    fused = fuse(vector_arm, text_arm, weight)
    if candidates is not None:
        # the fused lists are small: the candidates are looked up for them, not the other way round
        fused = written(fused, "fused", tidy=True)
        wanted = candidates.join(small(fused.select("id").distinct()), "id", "left_semi").select("id")
        fused = fused.join(wanted, "id", "left_semi")
    return top(fused, k)


def enrich(hits: DataFrame, records: DataFrame, payload_ids: DataFrame | None = None) -> DataFrame:
    """Hits with what a caller sees of their records; hits without a record are dropped, after the top k."""
    hits = written(hits, "hits", tidy=True)
    shown = records.select("id", "summary", F.coalesce("filename", F.lit("")).alias("filename"), "modality", "metadata", F.coalesce("parent_id", "id").alias("payload_id"))
    joined = shown.join(small(hits), "id")
    if payload_ids is None:
        return joined.withColumn("has_payload", F.lit(False)).drop("payload_id")
    there = payload_ids.select("payload_id").join(small(joined.select("payload_id").distinct()), "payload_id", "left_semi").distinct().withColumn("has_payload", F.lit(True))
    return joined.join(there, "payload_id", "left").withColumn("has_payload", F.coalesce("has_payload", F.lit(False))).drop("payload_id")
