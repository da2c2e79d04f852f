"""Command line: ingest, search, fetch, delete, ping, stats, config."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import preview_filename, preview_summary
from .plans.vault import Vault, VaultConfig


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--path", default="vault", help="folder of the vault")
    p.add_argument("--config", action="append", default=[], help="TOML file of settings; later ones and the environment override earlier ones")
    p.add_argument("--dim", type=int)
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest")
    one.add_argument("files")
    one.add_argument("--storage-mode", default="text_only")
    one = sub.add_parser("search")
    one.add_argument("text")
    one.add_argument("--top-k", type=int, default=5)
    one.add_argument("--weight", type=float, default=0.5)
    one.add_argument("--modality")
    one.add_argument("--filters", default="{}")
    one = sub.add_parser("fetch")
    one.add_argument("id")
    one.add_argument("--output")
    one.add_argument("--decompress", action="store_true")
    sub.add_parser("delete").add_argument("id")
    for name in ("ping", "stats", "config"):
        sub.add_parser(name)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    config = VaultConfig.load(*a.config)
    if a.dim is not None:
        config = config.changed("ingest", {"dim": a.dim})
    if a.command == "config":
        print(dataclasses.asdict(config))
        return 0
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    vault = Vault(spark, a.path, config)
    if a.command == "ping":
        print(vault.ping())
    elif a.command == "stats":
        vault.stats().show(truncate=False)
    elif a.command == "ingest":
        files = spark.read.format("binaryFile").load(a.files)
        vault.ingest(files.select(F.col("path").alias("file_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), "content", F.lit(a.storage_mode).alias("storage_mode"), F.lit("{}").alias("metadata"), F.lit(None).cast("string").alias("parent_id"))).show(truncate=False)
    elif a.command == "search":
        hits = vault.search(a.text, k=a.top_k, weight=a.weight, modality=a.modality, filters=a.filters)
        hits.select("id", preview_filename(F.col("filename")).alias("filename"), "modality", F.format_number("score", 4).alias("score"), preview_summary(F.col("summary")).alias("summary")).show(a.top_k, truncate=False)
    elif a.command == "fetch":
        data = vault.fetch(a.id, a.decompress)
        if a.output:
            with open(a.output, "wb") as f:
                f.write(data)
        else:
            sys.stdout.buffer.write(data)
    elif a.command == "delete":
        print(vault.delete(spark.createDataFrame([(a.id,)], "id string")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
