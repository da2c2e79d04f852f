"""Searches that arrive as a stream, answered from one pinned commit of a vault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import hybrid
from ..plans.vault import Vault
from ..sources.manifest import Files


def pinned(vault: Vault, out: str) -> int:
    """The commit that the answers in ``out`` come from: the newest one when the first stream began, whatever was written since."""
    files = Files(vault.spark, out)
    if not files.names("") or "_pinned" not in files.names(""):
        files.publish("_pinned", str(vault.store.snapshot().manifest.number))
    return int(files.read("_pinned"))


def answer(vault: Vault, queries: DataFrame, out: str, checkpoint: str, k: int = hybrid.DEFAULT_K, weight: float = hybrid.DEFAULT_WEIGHT, available_now: bool = True, **options) -> StreamingQuery:
    """Answers a stream of queries (qid, text and, if there are any, embedding) into ``out``, as ``Vault.search_batch`` does.

    All batches are answered from the same commit, also after a restart. The answers to a batch are a folder of its number: a batch
    that is delivered again overwrites its own, so each query is answered once. ``answers`` reads them.
    """
    snapshot = vault.store.snapshot(pinned(vault, out))

    def write(batch: DataFrame, batch_id: int) -> None:
        hits = vault.search_batch(batch, k, weight, index=snapshot, **options)
        hits.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def answers(vault: Vault, out: str) -> DataFrame:
    """All answers so far: the hits of ``search_batch`` with the batch that they belong to."""
    return vault.spark.read.option("basePath", out).parquet(f"{out}/batch=*")
