"""The thin ``opN_`` queries: each applies its operator to a whole table and derives the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blob_ledger, chroma, jaccard_join, language_id, lexical_search, line_dedup, packing, periodic_runs, ppm, pu_quality, replication, suffix_dedup, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 13-word windows of benchmark items."""
    found = winnowing.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        # as in the SQL, items without id count as one, which is not listed
        F.size(F.array_distinct("spans.item_id")).cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of pages from their words, markup, address and host; words are learned from documents."""
    return language_id.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents, learned from trusted positives and unlabelled text."""
    return pu_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in three documents or more go, except in the last."""
    cut = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with its sources at shares that follow the square root of their sizes."""
    mixed = replication.replicate(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "rate", "copy", "mix_key")


def op6_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, played as scores, aligned by their chroma fingerprints."""
    found = chroma.align(_table(spark, sf_dir, "documents"), chroma.melody, chroma.MELODY, "text")
    return found.withColumn("codes_sha256", F.sha2("codes", 256)).drop("codes")


def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents; each document is a version of the path that its id names."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    found = blob_ledger.scan(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of documents under a byte trie of all folds but one."""
    docs = _table(spark, sf_dir, "documents")
    fold = pu_quality.held_out("doc_id", 7, 2)
    scored = ppm.score(docs, docs.where(~fold))
    return scored.select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingles have Jaccard similarity 0.9 or more."""
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that stand in an earlier document go."""
    return suffix_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), digest=True)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of 2048 ids of a public vocabulary."""
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return lexical_search.search(lexical_search.index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of documents, one in ten made periodic, and digests of what is left without their repetitions."""
    docs = _table(spark, sf_dir, "documents")
    found = periodic_runs.periodic_runs(docs.select("doc_id", periodic_runs.stuttered(F.col("text"), F.col("doc_id")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    found = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_winnowing": op1_winnowing,
    "op2_language_id": op2_language_id,
    "op3_pu_quality": op3_pu_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_poisson_mix": op5_poisson_mix,
    "op6_chroma": op6_chroma,
    "op7_blob_ledger": op7_blob_ledger,
    "op8_ppm": op8_ppm,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_packing": op11_packing,
    "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}
