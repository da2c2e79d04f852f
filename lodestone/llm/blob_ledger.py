"""Secret scans with an incremental blob ledger, with DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its bytes.
The ledger in the shared folder says which (blob, rule, version of the rule)
have been scanned and what was found. A scan takes the blobs that have pairs
the ledger lacks, one copy of each, looks for the missing rules only, appends to
the ledger, and joins the findings back to all paths that hold the blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import folder, written


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost, non-overlapping; a match counts if ``group`` has ``least`` characters or more.

    ``hint`` is a pattern without which no match counts: it is tried first, as it is cheaper.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str


#: The base rules, in the order in which kinds are listed. A run of hexadecimal digits, or one that
#: begins with AKIA, is matched as a whole or not at all, so the least length stands in the pattern; after a short
#: assignment the search goes on behind it, so that length is tested afterwards.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", 1, "(AKIA[A-Z0-9]{14,})", 1, 18, "AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, "([0-9a-f]{16,})", 1, 16, "[0-9a-f]{16}"),
)

SCANNED = "blob binary, kind string, version int"
FOUND = "blob binary, kind string, version int, start long, end long"


def blob_of(text: Column) -> Column:
    """The address of a text: SHA-256 of its UTF-8 bytes; null is empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _ledger(spark, path: str, part: str, schema: str) -> DataFrame:
    empty = spark.createDataFrame([], schema)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
    there = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(base)
    return spark.read.schema(schema).parquet(f"{path}/{part}") if there else empty


def _matches(text: Column, rule: Rule) -> Column:
    """For each match: characters since the last one, its own, and those of the group that counts."""
    # one zipped array: each of the three passes over the text is made once, not once a match
    each = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part"),
    )
    each = F.transform(
        each,
        lambda m, i: F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"), i.alias("n"),
            F.char_length(m["gap"]).alias("gap"), F.char_length(m["whole"]).alias("size"), F.char_length(m["part"]).alias("counts"),
        ),
    )
    return F.filter(each, lambda m: m["size"].isNotNull())


def scan_unseen(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scans what the ledger lacks and appends it; findings are written before the pairs count as scanned.

    ``versions`` has (path, text); it may hold many versions of a path. If the
    job dies between the two writes, the next one scans the pairs again and the
    reader takes each finding once.
    """
    spark = versions.sparkSession
    addressed = versions.select("path", "text", blob_of(F.col("text")).alias("blob"))
    # the smallest path stands for a blob; partial sums keep a blob with very many paths small
    blobs = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    known = _ledger(spark, ledger, "scanned", SCANNED)
    wanted = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    # written once: a source that changes meanwhile must not mark blobs as scanned that were not
    pairs = written(blobs.join(F.broadcast(wanted)).join(known, ["blob", "kind", "version"], "left_anti"), "unseen-pairs")
    todo = pairs.groupBy("blob").agg(F.first("path").alias("path"), F.collect_set("kind").alias("kinds"))
    todo = todo.select(F.col("blob").alias("b"), F.col("path").alias("p"), "kinds")
    # path and blob find the row of the representative; paths are many, so no task gets a hot one
    texts = addressed.join(todo.hint("shuffle_hash"), (F.col("path").eqNullSafe(F.col("p"))) & (F.col("blob") == F.col("b")))
    run = uuid.uuid4().hex
    scans = F.array(*[F.when(F.array_contains("kinds", r.kind) & F.col("text").rlike(r.hint), _matches(F.col("text"), r)) for r in rules])
    each = texts.select("blob", F.explode(F.flatten(F.filter(scans, lambda x: x.isNotNull()))).alias("m")).select("blob", "m.*")
    # a version that stands twice under one path gives every match twice
    each = each.groupBy("blob", "kind", "version", "n").agg(F.first("least").alias("least"), F.first("gap").alias("gap"), F.first("size").alias("size"), F.first("counts").alias("counts"))
    before = Window.partitionBy("blob", "kind", "version").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    spans = each.withColumn("end", F.sum((F.col("gap") + F.col("size")).cast("long")).over(before)).where("counts >= least")
    spans.select("blob", "kind", "version", (F.col("end") - F.col("size")).alias("start"), "end").write.mode("append").parquet(f"{ledger}/found/run={run}")
    pairs.select("blob", "kind", "version").write.mode("append").parquet(f"{ledger}/scanned/run={run}")


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``versions``: path, blob, spans (kind, start, end; by start, then kind as listed)."""
    spark = versions.sparkSession
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    current = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    found = _ledger(spark, ledger, "found", FOUND).join(F.broadcast(current), ["kind", "version"]).select("blob", "kind", "start", "end").distinct()
    spans = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("rank"), "kind", "end"))).alias("spans"))
    spans = spans.select(F.col("blob").alias("b"), F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    # a table of its own: the join then has an exchange on either side, and a blob with very many paths can be split
    spans = written(spans, "findings")
    paths = versions.select("path", blob_of(F.col("text")).alias("blob"))
    return paths.join(spans, F.col("blob") == F.col("b"), "left").select("path", "blob", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:long,end:long>>")).alias("spans"))


def scan(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``scan_unseen`` and then ``findings``. Without a ledger, a new one is begun in the shared folder.

    Null texts are empty. Rows that are alike each get their row. Columns other
    than ``path`` and ``text`` are not read.
    """
    ledger = ledger or f"{folder(versions.sparkSession)}/ledger-{uuid.uuid4().hex}"
    versions = versions.select("path", "text")
    scan_unseen(versions, ledger, rules)
    return findings(versions, ledger, rules)
