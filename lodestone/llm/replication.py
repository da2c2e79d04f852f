"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source has a target share of the mixed corpus. Its documents are repeated
at a mean rate of share * budget / size of the source: the number of copies of
a document is the inverse of the Poisson distribution with that mean at a
uniform number taken from a hash of the seed and the document, so a task that
runs again gets the same number. Copies are exploded before the one shuffle,
which deals them by a hash of document and copy and sorts by it inside the
partitions: the global order is random, and the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import unused, written

#: Sources are weighted by their size to this power where no weights are given.
ALPHA = 0.5
#: Sources whose rates may be broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Beyond the mean by so many deviations (and 20) a double below 1 has nothing left.
DEVIATIONS = 12


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, from the MD5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _log_factorial(k: Column) -> Column:
    """ln k!, by Stirling's series at k + 9 and the way back down."""
    z = k + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0))) + 1 / (1188 * F.pow(z, F.lit(9.0)))
    down = F.lit(0.0)
    for i in range(1, 9):
        down = down + F.log(k + float(i))
    return series - down


def source_rates(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, size, rate): code points of each source, and the mean number of copies of its documents.

    ``weights`` has (source, weight); sources without a positive weight get rate 0.
    Without it a source weighs size to the power ``alpha``. ``budget`` is the size of
    the mixed corpus in code points, that of ``docs`` where it is None. A null source
    is a source. A source without a single character has nothing to weigh: its rate is 1.
    """
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.sqrt("size") if alpha == 0.5 else F.pow("size", F.lit(alpha)))
    else:
        given = weights.groupBy(F.col("source").cast("string").alias("__source")).agg(F.sum("weight").cast("double").alias("weight"))
        weighed = sizes.join(given, sizes["source"].eqNullSafe(given["__source"]), "left").drop("__source").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    total = weighed.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("all_weight"))
    rate = F.col("weight") / F.nullif(F.col("all_weight"), F.lit(0.0)) * (F.lit(float(budget)) if budget is not None else F.col("all_size")) / F.nullif(F.col("size"), F.lit(0))
    return weighed.join(F.broadcast(total)).select("source", "size", F.when(F.col("size") == 0, 1.0).otherwise(F.round(F.coalesce(rate, F.lit(0.0)), 9)).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """(source, rate, least, sums): P(X <= k) from k = ``least`` on, rounded to 12 digits."""
    spread = DEVIATIONS * F.sqrt("rate") + 20
    steps = rates.where("rate > 0").select(
        "source", "rate", F.greatest(F.lit(0), F.floor(F.col("rate") - spread)).alias("least"), F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("rate") - spread)), F.ceil(F.col("rate") + spread))).alias("k")
    )
    mass = F.exp(F.col("k") * F.log("rate") - F.col("rate") - _log_factorial(F.col("k")))
    running = F.sum(mass).over(Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    sums = steps.withColumn("sum", F.round(running, 12)).groupBy("source", "rate", "least").agg(F.array_sort(F.collect_list(F.struct("k", "sum"))).alias("sums"))
    return sums.select("source", "rate", "least", F.col("sums.sum").alias("sums"))


def replicate(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as drawn, all columns kept, in random order.

    Adds ``rate``, ``copy`` (1, 2, ...) and ``mix_key`` (the hash that orders the
    corpus); input columns of these names are replaced. Rows that are drawn 0
    times are not in the result. Rows alike in doc_id and text are drawn alike.
    Null texts have size 0; an empty table gives an empty table.
    """
    rates = written(source_rates(docs, weights, budget, alpha), "rates")
    of, given, drawn, copies = (unused(docs, name) for name in ("__of", "__table", "__drawn", "__copies"))
    tables = poisson_tables(rates).select(F.struct("source").alias(of), F.struct("rate", "least", "sums").alias(given))
    # beyond the bound a table of its own: the join then has an exchange on either side, and a hot source can be split
    tables = F.broadcast(tables) if rates.count() <= BROADCAST_SOURCES else written(tables, "poisson-tables")
    row = F.struct(F.lit(f"{seed}").alias("seed"), F.col("doc_id").cast("string").alias("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    rows = docs.withColumn(drawn, row).join(tables, F.struct(F.col("source").cast("string").alias("source")).eqNullSafe(F.col(of)))
    d, t = F.col(drawn), F.col(given)
    u = uniform(d["seed"], d["doc_id"], d["text"])
    rows = rows.withColumn(copies, (t["least"] + F.size(F.filter(t["sums"], lambda s: s <= u))).cast("int")).where(F.col(copies) > 0)
    rows = rows.withColumns({"rate": t["rate"], "copy": F.explode(F.sequence(F.lit(1), F.col(copies)))})
    rows = rows.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit("mix"), d["seed"], F.coalesce(d["doc_id"], F.lit("")), d["text"], F.col("copy").cast("string"))))
    rows = rows.drop(drawn, of, given, copies)
    return rows.repartition("mix_key").sortWithinPartitions("mix_key")
