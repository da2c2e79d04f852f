"""The vault: ingest, search, fetch, delete, ping and stats over a store."""

from __future__ import annotations

import os
import time
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import decompress
from ..functions.metadata import usable
from ..functions.text import tokenize_query
from ..operators import bm25, hybrid, vector
from ..schema import InvalidInputError, NotFoundError, parse_modality
from ..sources.store import Snapshot, Store, ratio
from .ingest import IngestConfig, embedded_queries, put


@dataclass(frozen=True)
class VaultConfig:
    k1: float = bm25.K1
    b: float = bm25.B
    #: ``post`` filters the fused lists, so that a narrow filter may leave fewer hits than asked for; ``pre`` filters before ranking.
    filter_mode: str = "post"
    ingest: IngestConfig = field(default_factory=IngestConfig)

    @classmethod
    def load(cls, *files: str, environ: Mapping[str, str] | None = None, prefix: str = "LODESTONE") -> VaultConfig:
        """Defaults, then TOML files in their order (those that are missing are passed over), then the environment.

        Files have settings of searches in the table ``search`` and of ingests in ``ingest``; in the environment
        they are ``LODESTONE__SEARCH__K1`` or ``LODESTONE__INGEST__CHUNK_WORDS``. Models are objects and cannot be named here.
        """
        config = cls()
        for name in files:
            if os.path.exists(name):
                with open(name, "rb") as f:
                    for section, settings in tomllib.load(f).items():
                        config = config.changed(section, settings)
        for name, value in sorted((os.environ if environ is None else environ).items()):
            if name.upper().startswith(f"{prefix}__"):
                section, _, key = name.lower()[len(prefix) + 2 :].partition("__")
                config = config.changed(section, {key: value})
        return config

    def changed(self, section: str, settings: Mapping[str, object]) -> VaultConfig:
        """With other settings of ``search`` or ``ingest``; strings become what the setting's default is."""
        if section not in ("search", "ingest") or not isinstance(settings, Mapping):
            raise InvalidInputError(f"no section {section} of settings")
        own = self if section == "search" else self.ingest
        known = {f.name: getattr(type(own)(), f.name) for f in fields(own) if f.name not in ("ingest", "summarizer", "embedder", "providers")}
        values = {}
        for key, value in settings.items():
            if key not in known:
                raise InvalidInputError(f"no setting {key} in {section}")
            try:
                values[key] = (float if known[key] is None else type(known[key]))(value)
            except (TypeError, ValueError) as e:
                raise InvalidInputError(f"{section}.{key}: {value}") from e
        return replace(self, **values) if section == "search" else replace(self, ingest=replace(self.ingest, **values))


class Vault:
    """Facade over one store; all methods take and give DataFrames unless they ask for one id."""

    def __init__(self, spark: SparkSession, path: str, config: VaultConfig | None = None) -> None:
        self.spark, self.store, self.config = spark, Store(spark, path), config or VaultConfig()
        self.started = time.time()

    def ping(self) -> str:
        return "pong"

    def ingest(self, files: DataFrame) -> DataFrame:
        """Ingests files in one commit and tells for each record its id and sizes."""
        version = self.store.next_version()
        put(self.store, files, self.config.ingest, version)
        return self.store.written_records(version).select("id", "parent_id", "chunk_index", "total_chunks", "original_size", "compressed_size")

    def index(self) -> Snapshot:
        """Records and index as they are now: searches that are given it don't see what is written later."""
        return self.store.snapshot()

    def search_batch(self, queries: DataFrame, k: int = hybrid.DEFAULT_K, weight: float = hybrid.DEFAULT_WEIGHT, modality: str | None = None, filters: dict | str | None = None, index: Snapshot | None = None) -> DataFrame:
        """Hits of many queries (qid, text, embedding): qid, id, score, rank and what is shown of the records. Without embeddings, texts are embedded as records are."""
        if k < 0:
            raise InvalidInputError("k must not be negative")
        now = index or self.store.snapshot()
        if "embedding" not in queries.columns:
            queries = embedded_queries(queries, self.config.ingest)
        records = now.records()
        modality, wanted = parse_modality(modality) if modality else None, usable(filters)
        candidates = now.candidates(modality, wanted) if modality or wanted else None
        tokens = queries.select("qid", F.explode(tokenize_query(F.coalesce("text", F.lit("")))).alias("token"))
        post, stats, df, vectors = now.postings(tokens), now.corpus_stats(), now.frequencies(tokens), records.select("id", "embedding")
        if candidates is not None and self.config.filter_mode == "pre":
            # statistics are those of what is left
            searched = records.join(candidates, "id", "left_semi")
            post, stats, df, vectors = post.join(candidates, "id", "left_semi"), bm25.corpus_stats(searched), None, searched.select("id", "embedding")
        text_arm = bm25.top(bm25.scores(post, stats, tokens, self.config.k1, self.config.b, df), k * hybrid.OVER_FETCH)
        vector_arm = vector.search(vectors, queries.select("qid", "embedding"), k * hybrid.OVER_FETCH)
        hits = hybrid.hybrid(vector_arm, text_arm, k, weight, candidates if self.config.filter_mode == "post" else None)
        return hybrid.enrich(hits, records, now.payload_ids())

    def search(self, text: str = "", embedding: list[float] | None = None, **options) -> DataFrame:
        """One query, by text, by vector or both; without a vector the text is embedded as records are."""
        query = self.spark.createDataFrame([(0, text)], "qid int, text string")
        if embedding is not None:
            query = self.spark.createDataFrame([(0, text, [float(x) for x in embedding])], "qid int, text string, embedding array<float>")
        return self.search_batch(query, **options).drop("qid").orderBy("rank")

    def fetch(self, id: str, unpack: bool = False) -> bytes:
        """The stored bytes of a record, or the original ones."""
        found = self.store.fetch(self.spark.createDataFrame([(id,)], "id string"))
        if unpack:
            found = found.withColumn("payload", decompress(F.col("payload"), F.col("codec.kind"), F.col("original_size")))
        row = found.select("payload").first()
        if row is None:
            raise NotFoundError(id)
        return bytes(row[0])

    def fetch_frames(self, ids: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
        """(id, chunk_index, data, total_bytes) of the stored bytes from ``start`` to ``stop``, frame by frame."""
        return self.store.snapshot().fetch_range(ids, start, stop)

    def delete(self, ids: DataFrame) -> int:
        """Number of records deleted; an error if one of the ids is not there."""
        missing = self.store.exists(ids).where("not found").select("id").first()
        if missing is not None:
            raise NotFoundError(missing["id"])
        n = ids.distinct().count()
        self.store.delete(ids)
        return n

    def stats(self) -> DataFrame:
        """One row: records, bytes before and after compression (each file once), mean ratio, bytes of the index, uptime. Nothing is scanned."""
        return self.store.snapshot().stats().withColumn("uptime_seconds", F.lit(int(time.time() - self.started)).cast("long"))


def vault_stats(records: DataFrame) -> DataFrame:
    """(total_records, total_payload_bytes, total_compressed_bytes, avg_compression_ratio); chunks of one file share its bytes."""
    first = F.col("chunk_index") == 0
    return records.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.coalesce(F.sum(F.when(first, F.col("original_size"))), F.lit(0)).alias("total_payload_bytes"),
        F.coalesce(F.sum(F.when(first, F.col("compressed_size"))), F.lit(0)).alias("total_compressed_bytes"),
        F.round(F.coalesce(F.avg(ratio()), F.lit(0.0)), 6).alias("avg_compression_ratio"),
    )


def ingest_totals(records: DataFrame) -> DataFrame:
    """One row for what an ingest wrote: files, records, bytes before and after compression (each file once), its share, and the first record's id."""
    first = F.col("chunk_index") == 0
    sizes = [F.coalesce(F.sum(F.when(first, F.col(c))), F.lit(0)).cast("long") for c in ("original_size", "compressed_size")]
    totals = records.agg(F.count_if(first).alias("files"), F.count(F.lit(1)).alias("records"), sizes[0].alias("original_bytes"), sizes[1].alias("stored_bytes"), *([F.min_by("id", F.struct("chunk_index", "id")).alias("first_id")] if "id" in records.columns else []))
    return totals.withColumn("share", F.round(F.coalesce(F.col("stored_bytes") / F.nullif(F.col("original_bytes"), F.lit(0)), F.lit(0.0)), 6))


def parent_rollup(records: DataFrame) -> DataFrame:
    """(parent_id, chunks, text): the chunks of each parent in their order; a parent becomes one text, so it may have 2 GB at most."""
    grouped = records.where("parent_id is not null").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "summary"))).alias("all"))
    return grouped.select("parent_id", F.size("all").cast("long").alias("chunks"), F.array_join("all.summary", "\n").alias("text"))
