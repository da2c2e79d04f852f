"""Uploads that arrive in parts, as a stream: keyed state that lets a file go when all its parts are there."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .stream_ingest import defaults

#: An upload that gets no further part for so long (milliseconds) is given up; one that is over is remembered as long.
TIMEOUT_MS = 3_600_000
#: Bytes of an upload beyond which it is given up: state is for what is under way, and files become one value.
MOST_BYTES = 1 << 30

FILE = "file_id string, filename string, content binary, error string"


def _row(key: tuple, filename: str, content: bytes | None, error: str | None) -> pd.DataFrame:
    return pd.DataFrame({"file_id": [key[0]], "filename": [filename], "content": [content], "error": [error]})


class Upload(StatefulProcessor):
    """State of one upload: its parts by index, each written once; name, number of parts, parts and bytes so far; whether it is over."""

    def __init__(self, timeout_ms: int = TIMEOUT_MS, most_bytes: int = MOST_BYTES) -> None:
        self.timeout_ms, self.most_bytes = timeout_ms, most_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "chunk_index int", "data binary")
        self.about = handle.getValueState("about", "filename string, total int, held int, bytes long, over boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        filename, total, held, size, over = self.about.get() if self.about.exists() else ("", 0, 0, 0, False)
        error = None
        for pdf in rows:
            for name, index, of, data in zip(pdf["filename"], pdf["chunk_index"], pdf["total_chunks"], pdf["data"], strict=True):
                index, of, data = int(index), int(of), bytes(data)
                filename = name or filename
                if over:
                    continue
                if of < 1 or not 0 <= index < of or (total and of != total):
                    error = error or f"part {index} of {of} does not fit an upload of {total or of} parts"
                    continue
                total = of
                if not self.parts.containsKey((index,)):
                    self.parts.updateValue((index,), (data,))
                    held, size = held + 1, size + len(data)
                elif bytes(self.parts.getValue((index,))[0]) != data:
                    error = error or f"part {index} came twice with other bytes"
        if not over:
            if size > self.most_bytes:
                error = error or f"more than {self.most_bytes} bytes"
            if error or held == total:
                content = None if error else b"".join(bytes(self.parts.getValue((i,))[0]) for i in range(total))
                self.parts.clear()
                over = True
                yield _row(key, filename, content, error)
        self.about.update((filename, total, held, size, over))
        # the timer begins anew
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.about.exists():
            filename, total, held, _, over = self.about.get()
            self.parts.clear()
            self.about.clear()
            if not over:
                yield _row(key, filename, None, f"{total - held} of {total} parts are missing")

    def close(self) -> None:
        pass


def state_store(spark: SparkSession) -> None:
    """Keyed state with timers is kept in RocksDB: set before such a stream is started."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def only_data(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within run no batches without data, so that they end with their input; their timers wait for the next batch."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def uploads(parts: DataFrame, timeout_ms: int = TIMEOUT_MS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A stream of files (file_id, filename, content, error, ...) from a stream of parts (upload_id, filename, chunk_index, total_chunks, data).

    Parts may come in any order, in any number of batches and more than once. An upload ends with its last part; with an error (and no content) where
    parts contradict each other, where it is too large, or where no part has come for ``timeout_ms``. Parts of an
    upload that is over are dropped for as long. Parts without upload_id, place or data are dropped. What is under way is state, which
    a restarted stream takes from its checkpoint. A stream with timers has always another batch to run: one that is to end with
    its input is started within ``only_data``.
    """
    state_store(parts.sparkSession)
    good = parts.where("upload_id is not null and data is not null and chunk_index is not null and total_chunks is not null")
    rows = good.select(F.col("upload_id").cast("string").alias("upload_id"), F.coalesce("filename", F.lit("")).alias("filename"), F.col("chunk_index").cast("int").alias("chunk_index"), F.col("total_chunks").cast("int").alias("total_chunks"), "data")
    files = rows.groupBy("upload_id").transformWithStateInPandas(Upload(timeout_ms, most_bytes), FILE, "Append", "ProcessingTime")
    return files.select("file_id", "filename", "content", "error", *defaults())
