"""Streaming ingest: a file source feeds the ingest pipeline, one version per micro-batch."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import IngestConfig, put
from ..sources.shared import written
from ..sources.store import Store


def defaults() -> list[Column]:
    """What files have that come without it."""
    return [F.lit("text_only").alias("storage_mode"), F.lit("{}").alias("metadata"), F.lit(None).cast("string").alias("parent_id")]


def watch(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of files: (file_id, filename, content, storage_mode, metadata, parent_id)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return files.select(
        F.col("path").alias("file_id"),
        F.regexp_extract("path", "([^/]*)$", 1).alias("filename"),
        "content",
        *defaults(),
    )


def assemble_uploads(chunks: DataFrame) -> DataFrame:
    """Byte chunks (upload_id, filename, chunk_index, data) of a table to files: what a client sends in parts is one file.

    Parts of one upload are put together in their order; a part that was sent twice counts once. Where there is a column
    total_chunks, uploads that lack parts are left out. An upload becomes one value, so it may have 2 GB at most.
    """
    parts = chunks.dropDuplicates(["upload_id", "chunk_index"]).groupBy("upload_id").agg(
        F.max("filename").alias("filename"),
        F.expr("listagg(data) within group (order by chunk_index)").alias("content"),
        F.count(F.lit(1)).alias("__n"),
        *([F.max("total_chunks").alias("__total")] if "total_chunks" in chunks.columns else []),
    )
    if "total_chunks" in chunks.columns:
        parts = parts.where("__n = __total")
    return parts.select(F.col("upload_id").alias("file_id"), "filename", "content", *defaults())


def into_store(files: DataFrame, store: Store, checkpoint: str, config: IngestConfig | None = None, available_now: bool = True) -> StreamingQuery:
    """Runs the stream into the store.

    A batch gets a version above all that the store has, whoever wrote them, so it wins over what
    came before it. Rows with an ``error`` go to the store's folder of errors. Streams are known by the id in their checkpoint: a batch that is delivered again overwrites its own
    version, and no other stream's. Records are written once; their metadata is taken from what was written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        if "error" in batch.columns:
            batch = written(batch, "uploads")
            batch.where("error is not null").select("file_id", "filename", "error").write.mode("overwrite").parquet(f"{store.path}/errors/stream={stream}/batch={batch_id}")
            batch = batch.where("error is null").drop("error")
        put(store, batch, config, store.version_of(stream, batch_id))

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
