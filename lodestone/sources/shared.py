"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of stored input for each partition of what is dealt by a key or sorted: tasks grow in number with the input, not in size.
PART_BYTES = 16 << 20


def n_parts(n_bytes: int, least: int = 1, each: int = PART_BYTES) -> int:
    """Partitions for so many stored bytes."""
    return max(least, -(-n_bytes // each))


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` is read from; 0 where there are none."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where that is unset and all tasks run on this machine, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Spark's setting for shuffle files that go at the end of a query.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes of an Arrow batch.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def settings(spark: SparkSession, asked: dict[str, str]) -> Iterator[None]:
    """Spark's settings as they are asked for, and afterwards as they were."""
    before = {k: spark.conf.get(k, None) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, what: str, files: int | None = None, tidy: bool = False, batch_bytes: int | None = None) -> DataFrame:
    """``df`` as a Parquet table of its own: what reads it several times, or after an executor is lost, does not compute it again.

    ``files`` is at most how many files (and last tasks) it takes, for tables known to be small. With ``tidy`` what was shuffled
    for it is deleted once it is there. ``batch_bytes`` bounds the Arrow batches that Python gets meanwhile (one row at least).
    """
    path = f"{folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df = df.coalesce(files) if files else df
    with settings(df.sparkSession, ({TIDY: "true"} if tidy else {}) | ({BATCH: str(batch_bytes)} if batch_bytes else {})):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
