"""Answers of remote models, kept by content: each distinct prompt is asked for once, and failed ones are told apart.

Requests are keyed by the hash of their kind and text. Keys that the table of answers lacks are dealt to tasks, each of which keeps
``concurrency`` calls running; a job's rate is shared out among its tasks. What fails is tried again and, if it fails still, becomes an
error of its rows only: it is not kept, so the next job asks for it again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ProviderError
from .shared import written

#: Tasks that calls are dealt to at most: the rate is shared out among them.
CALL_TASKS = 64


class FinalError(ProviderError):
    """An answer that trying again won't mend."""


@dataclass(frozen=True)
class Calls:
    """Tries of a call, the pause before the second (it doubles from then on), calls at a time in a task, and calls a second in a job."""

    attempts: int = 3
    pause: float = 0.5
    concurrency: int = 4
    rate: float | None = None


def _once(call: Callable[[], Any], calls: Calls) -> tuple[Any, str | None]:
    for i in range(calls.attempts):
        try:
            return call(), None
        except FinalError as e:
            return None, str(e)
        except Exception as e:  # a provider may raise anything
            error = str(ProviderError(e))
        if i + 1 < calls.attempts:
            time.sleep(calls.pause * 2**i)
    return None, error


def _call_task(call: Callable[[str | None, str], Any], calls: Calls, tasks: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap = tasks / calls.rate if calls.rate else 0.0
        due = time.monotonic()
        with ThreadPoolExecutor(calls.concurrency) as pool:
            for pdf in batches:
                running = []
                for kind, text in zip(pdf["kind"], pdf["text"], strict=True):
                    if gap:
                        time.sleep(max(0.0, due - time.monotonic()))
                        due = max(due, time.monotonic()) + gap
                    running.append(pool.submit(_once, lambda k=kind, t=text: call(k, t), calls))
                done = [r.result() for r in running]
                yield pd.DataFrame({"key": pdf["key"], "answer": [a for a, _ in done], "error": [e for _, e in done]})

    return run


def ask(rows: DataFrame, call: Callable[[str | None, str], Any], kind: str, calls: Calls = Calls(), table: str | None = None) -> DataFrame:
    """``rows`` with ``answer`` (of type ``kind``) and ``error`` for the request in ``__kind`` and ``__about``: one of the two is null.

    Answers are kept in ``table``, if it is given, and looked up there first. A null text is asked for as an empty one.
    """
    spark = rows.sparkSession
    key = F.sha2(F.concat(F.coalesce("__kind", F.lit("")), F.lit("\x00"), F.coalesce("__about", F.lit(""))), 256)
    rows = rows.withColumn("__key", key)
    wanted = rows.groupBy(F.col("__key").alias("key")).agg(F.first("__kind").alias("kind"), F.coalesce(F.first("__about"), F.lit("")).alias("text"))
    known = spark.createDataFrame([], f"key string, answer {kind}")
    if table:
        known = spark.read.schema(known.schema).option("ignoreMissingFiles", "true").parquet(f"{table}") if _there(spark, table) else known
        wanted = wanted.join(known, "key", "left_anti")
    tasks = min(CALL_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    fresh = written(wanted.repartition(tasks).mapInPandas(_call_task(call, calls, tasks), f"key string, answer {kind}, error string"), "answers")
    if table:
        fresh.where("error is null").select("key", "answer").write.mode("append").parquet(table)
    both = known.select("key", "answer", F.lit(None).cast("string").alias("error")).unionByName(fresh) if table else fresh
    # a prompt that two jobs asked for at once has two answers, of which one counts
    both = both.dropDuplicates(["key"])
    return rows.join(both, rows["__key"] == both["key"], "left").drop("__key", "key")


def _there(spark, table: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
