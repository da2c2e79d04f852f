"""BM25 over a postings table.

The index is two tables: ``postings`` (token, id, tf, doc_len), range partitioned
and sorted by token when it is stored, so that a query's few tokens prune row
groups; and one row of corpus statistics. Nothing of a document's text or token
array goes through a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
#: Queries (or rows of a top list) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Digits that scores keep before they are ranked: sums depend on their order beyond that.
DIGITS = 9


def postings(records: DataFrame, tokens: str = "bm25_tokens", key: str = "id") -> DataFrame:
    """(token, id, tf, doc_len): one row per distinct token of a record."""
    return counted(flat(records, tokens, key))


def flat(records: DataFrame, tokens: str = "bm25_tokens", key: str = "id") -> DataFrame:
    """(id, doc_len, token): one row per token of a record, with repetitions."""
    return records.select(F.col(key).alias("id"), F.size(tokens).alias("doc_len"), F.explode(tokens).alias("token"))


def counted(rows: DataFrame) -> DataFrame:
    """``postings`` from ``flat`` rows."""
    return rows.groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))


def sorted_postings(records: DataFrame, n: int, tokens: str = "bm25_tokens", key: str = "id") -> DataFrame:
    """``postings`` in ``n`` ranges of (token, id), each sorted. They are counted where their range is, so rows are shuffled once."""
    return counted(flat(records, tokens, key).repartitionByRange(n, "token", "id")).sortWithinPartitions("token", "id")


def corpus_stats(records: DataFrame, tokens: str = "bm25_tokens") -> DataFrame:
    """One row (n, avg_len): records without tokens count, an empty corpus has length 0."""
    return records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size(tokens)), F.lit(0.0)).alias("avg_len"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows, else left to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def scores(post: DataFrame, stats: DataFrame, query_tokens: DataFrame, k1: float = K1, b: float = B, frequencies: DataFrame | None = None) -> DataFrame:
    """(qid, id, score) of all records that hold a token of the query; ``query_tokens`` has (qid, token).

    ``frequencies`` (token, df) of these tokens, where an index keeps them; else they are counted from the rows that survive.
    """
    wanted = query_tokens.select("token").distinct()
    hits = post.join(small(wanted), "token", "left_semi")
    # one row a token of the queries: looked at for their size, and then broadcast, so that no posting is shuffled by token
    hits = hits.join(small(document_frequency(hits) if frequencies is None else frequencies), "token").join(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.coalesce(F.col("doc_len") / F.nullif(F.col("avg_len"), F.lit(0.0)), F.lit(0.0))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * norm))
    per = hits.select("token", "id", weight.alias("weight")).join(small(query_tokens), "token")
    return per.groupBy("qid", "id").agg(F.round(F.sum("weight"), DIGITS).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k best of each query, ties by id."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
