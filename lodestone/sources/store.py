"""The vault's tables: records, payloads, metadata and their index, as segments of Parquet under commits.

A write appends a segment to each table that it touches and publishes one commit (``manifest``), so readers see all of it or nothing.
Rows are upserted by id: a segment of ``..._gone`` names the ids whose older rows no longer count, and up to which version. Tables that are
keyed by id are bucketed by it, so rows meet what is gone without a shuffle, and a look-up reads the buckets of its ids.

The index is kept in segments too: postings in the buckets of their records, sorted by token in each; frequencies of tokens as differences;
and the string values of metadata sorted by key and value. Postings are made, merged and scored where their records lie, so none is
shuffled, and a file names few ids, often. A write reads its own texts and, of older rows, only ids and what it must subtract. Segments of like size
are merged when there are ``FAN`` of them. ``compact`` writes what counts as one segment; ``vacuum`` deletes what no kept commit names.
"""

from __future__ import annotations

import hashlib
import math
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metadata import string_fields
from ..operators import bm25
from ..schema import PAYLOAD, RECORD, NotFoundError, StorageError
from .manifest import FIGURES, Commits, ConflictError, Files, Manifest, Segment
from .shared import TIDY, n_parts, settings, stored_bytes

#: Bytes in one frame of a stored payload.
FRAME_BYTES = 1 << 20
#: Buckets of a new store at least: as many tasks read a table. A first write of many bytes makes more (``shared.PART_BYTES`` each).
BUCKETS = 8
#: Index segments of one size class that are merged, and the ratio from one class to the next.
FAN = 4
#: Times that a write begins anew because another was quicker.
ATTEMPTS = 5

METADATA = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("metadata", T.StringType())])

_GONE = "id string, upto bigint, n_tokens bigint, payload_bytes bigint, compressed_bytes bigint, ratio double, tokens array<string>"
_columns = lambda kind: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.fields)
#: Columns of each table, and the one that buckets it; what has none is sorted by its first columns.
TABLES: dict[str, tuple[str, str | None]] = {
    "records": (f"{_columns(RECORD)}, born bigint", "id"),
    "records_gone": (_GONE, "id"),
    "metadata": (f"{_columns(METADATA)}, born bigint", "id"),
    "metadata_gone": (_GONE, "id"),
    "payloads": ("payload_id string, frame int, data binary, total_bytes bigint, born bigint", "payload_id"),
    "payloads_gone": (_GONE, "id"),
    "postings": ("token string, id string, tf bigint, doc_len int, born bigint", "id"),
    "terms": ("token string, df bigint", None),
    "fields": ("key string, value string, id string, born bigint", None),
}
#: What buckets are sorted by, where that isn't their key.
SORTED = {"postings": ("token", "id")}
#: Bytes of a dictionary of ids: a bucket's ids go into one, and rows of postings name them by number.
DICTIONARY_BYTES = 8 << 20
#: Spark's settings for writing rows that lie in their buckets, sorted: a writer that stays open for one bucket takes them as they come (with a ``sortBy``, or
#: without such a writer, Spark sorts them again, by the hash of their key first), and equal keys, side by side, are counted without a table of them.
IN_BUCKETS = {"spark.sql.maxConcurrentOutputFileWriters": "1", "spark.sql.execution.replaceHashWithSortAgg": "true"}
#: What is derived from a table, and is replaced and compacted with it.
WITH = {"records": ("records", "records_gone", "postings", "terms"), "metadata": ("metadata", "metadata_gone", "fields"), "payloads": ("payloads", "payloads_gone")}


def ratio() -> Column:
    """Bytes of a record before compression over those after it, in DOUBLE: the column is FLOAT, whose error may show in a mean's last digit. Without compressed bytes it is what the record says, by convention."""
    return F.coalesce(F.col("original_size") / F.nullif(F.col("compressed_size"), F.lit(0)), F.col("compression_ratio").cast("double"))


def latest(df: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The row of the highest version of each key; versions of one key must differ.

    The highest version is found on the two narrow columns, and joined back.
    """
    newest = df.groupBy(key).agg(F.max(version).alias("__version")).withColumnRenamed(key, "__key")
    return df.join(newest, (F.col(key) == F.col("__key")) & (F.col(version) == F.col("__version")), "left_semi")


def frames(payloads: DataFrame, size: int = FRAME_BYTES) -> DataFrame:
    """(id, chunk_index, data, total_bytes) from (id, payload): one row per ``size`` bytes; an empty payload has one empty frame."""
    total = F.octet_length("payload")
    split = payloads.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((total - 1) / size), F.lit(0)).cast("int"))))
    return split.select("id", "chunk_index", F.substring(F.col("payload"), F.col("chunk_index") * size + 1, F.lit(size)).alias("data"), total.cast("long").alias("total_bytes"))


class Snapshot:
    """A store as one commit has it; what is written later doesn't change it."""

    def __init__(self, store: Store, manifest: Manifest) -> None:
        self.store, self.manifest, self.spark = store, manifest, store.spark

    def segments(self, table: str, names: Sequence[int] | None = None) -> DataFrame:
        """The rows of a table's segments, whether they still count or not."""
        names = [s.name for s in self.manifest.of(table)] if names is None else list(names)
        if not names:
            return self.spark.createDataFrame([], TABLES[table][0])
        return self.store.table(table, names).where(F.col("segment").isin(names)).drop("segment")

    def _counting(self, df: DataFrame, table: str, key: str = "id") -> DataFrame:
        """Without the rows that newer versions replace. The key alone is an equality, so buckets meet as they lie."""
        if not self.manifest.of(f"{table}_gone"):
            return df
        gone = self.segments(f"{table}_gone").select(F.col("id").alias("__id"), "upto")
        return df.join(gone, (F.col(key) == F.col("__id")) & (F.col("born") <= F.col("upto")), "left_anti")

    def records(self, born: bool = False) -> DataFrame:
        rows = self._counting(self.segments("records"), "records")
        return rows if born else rows.drop("born")

    def metadata(self, born: bool = False) -> DataFrame:
        rows = self._counting(self.segments("metadata"), "metadata")
        return rows if born else rows.drop("born")

    def held(self) -> DataFrame:
        """Ids of the payloads that records refer to."""
        return self.records().select(F.coalesce("parent_id", "id").alias("payload_id")).distinct()

    def payload_frames(self, born: bool = False) -> DataFrame:
        """(payload_id, frame, data, total_bytes) of the payloads that records refer to."""
        rows = self._counting(self.segments("payloads"), "payloads", "payload_id").join(self.held(), "payload_id", "left_semi")
        return rows if born else rows.drop("born")

    def payload_ids(self) -> DataFrame:
        return self.payload_frames().where("frame = 0").select("payload_id")

    def payloads(self) -> DataFrame:
        """(payload_id, payload): frames put together; a payload of more than 2 GB is only read by frames."""
        return self.payload_frames().groupBy("payload_id").agg(F.expr("listagg(data) within group (order by frame)").alias("payload"))

    def payload_sizes(self) -> DataFrame:
        return self.payload_frames().where("frame = 0").select("payload_id", F.col("total_bytes").alias("size"))

    def lookup(self, ids: Sequence[str]) -> DataFrame:
        """The records of a few ids, from their buckets."""
        return self.records().where(F.col("id").isin(list(ids)))

    def get_record(self, id: str):
        rows = self.lookup([id]).take(1)
        if not rows:
            raise NotFoundError(id)
        return rows[0]

    def exists(self, ids: DataFrame) -> DataFrame:
        """(id, found) for each id asked for."""
        there = self.records().select("id", F.lit(True).alias("found"))
        return ids.select("id").join(there, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))

    def search_metadata(self, key: str, value: str) -> DataFrame:
        """Ids whose metadata has this string under this key, from the sorted fields: row groups of other keys and values are not read."""
        found = self.segments("fields").where((F.col("key") == key) & (F.col("value") == value))
        return self._counting(found, "metadata").select("id")

    def candidates(self, modality: str | None, filters: dict[str, str]) -> DataFrame:
        """Ids of one modality with all of these string values."""
        found = self.records().where(F.col("modality") == modality).select("id") if modality else None
        for key, value in filters.items():
            own = self.search_metadata(key, value)
            found = own if found is None else found.join(own, "id", "left_semi")
        return self.records().select("id") if found is None else found

    def _looked_up(self, table: str, tokens: DataFrame | None) -> DataFrame:
        """Rows of ``tokens`` (token), if given. As many as Parquet takes one by one are named in the scan, which reads their pages of sorted files; more are joined."""
        rows = self.segments(table)
        if tokens is None:
            return rows
        wanted, few = tokens.where("token is not null").select("token").distinct(), int(self.spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold"))
        named = [r.token for r in wanted.limit(few + 1).collect()]
        return rows.where(F.col("token").isin(named)) if len(named) <= few else rows.join(bm25.small(wanted), "token", "left_semi")

    def postings(self, tokens: DataFrame | None = None) -> DataFrame:
        """(token, id, tf, doc_len) of records that count; of ``tokens`` (token), if given, which are looked up in the sorted buckets."""
        return self._counting(self._looked_up("postings", tokens), "records").drop("born")

    def frequencies(self, tokens: DataFrame | None = None) -> DataFrame:
        """(token, df): the differences of all segments added up."""
        return self._looked_up("terms", tokens).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def corpus_stats(self) -> DataFrame:
        """One row (n, avg_len), from the commit: nothing is scanned."""
        n = int(self.manifest.total("records"))
        return self.spark.createDataFrame([(n, self.manifest.total("tokens") / n if n else 0.0)], "n long, avg_len double")

    def stats(self) -> DataFrame:
        """One row of figures, from the commit: records, bytes before and after compression (each file once), mean ratio (of records that have one), bytes of the index."""
        n = int(self.manifest.total("records"))
        index = sum(s.size for t in ("postings", "terms", "fields") for s in self.manifest.of(t))
        rated = n - int(self.manifest.total("unrated"))
        row = (n, int(self.manifest.total("payload_bytes")), int(self.manifest.total("compressed_bytes")), round(self.manifest.total("ratio_sum") / rated, 6) if rated else 0.0, index)
        return self.spark.createDataFrame([row], "total_records long, total_payload_bytes long, total_compressed_bytes long, avg_compression_ratio double, index_size long")

    def fetch(self, ids: DataFrame) -> DataFrame:
        """(id, codec, original_size, payload): stored bytes by the id of any chunk; ids without a payload are left out."""
        return self._wanted(ids).join(self.payloads(), "payload_id").select("id", "codec", "original_size", "payload")

    def _wanted(self, ids: DataFrame) -> DataFrame:
        return self.records().join(ids.select("id").distinct(), "id", "left_semi").select("id", "codec", "original_size", F.coalesce("parent_id", "id").alias("payload_id"))

    def fetch_range(self, ids: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
        """(id, chunk_index, data, total_bytes): the stored bytes from ``start`` to ``stop``, frame by frame; other frames are not read."""
        low, high = F.col("frame") * FRAME_BYTES, (F.col("frame") + 1) * FRAME_BYTES
        rows = self.payload_frames().where((F.col("frame") >= start // FRAME_BYTES) & (high > start))
        if stop is not None:
            rows = rows.where((low < stop) & (F.col("frame") <= max(0, stop - 1) // FRAME_BYTES))
        first = F.greatest(F.lit(start) - low, F.lit(0))
        last = F.least(F.lit(stop if stop is not None else 1 << 62) - low, F.lit(FRAME_BYTES))
        cut = rows.select("payload_id", F.col("frame").alias("chunk_index"), F.substring(F.col("data"), (first + 1).cast("int"), (last - first).cast("int")).alias("data"), "total_bytes")
        return self._wanted(ids).select("id", "payload_id").join(cut, "payload_id").select("id", "chunk_index", "data", "total_bytes")

    def damaged(self) -> DataFrame:
        """(table, segment, file, reason) of what can't be read: files that give no row, and segments with fewer rows than were written."""
        found: list[tuple[str, int, str | None, str]] = []
        for table in TABLES:
            for s in self.manifest.of(table):
                at = f"{table}/segment={s.name}"
                listed = {n for n in self.store.files.names(at) if n.endswith(".parquet")}
                rows = self.spark.read.schema(TABLES[table][0]).option("ignoreCorruptFiles", "true").parquet(f"{self.store.path}/{at}")
                read = {r.file.rpartition("/")[2]: r.n for r in rows.groupBy(F.input_file_name().alias("file")).agg(F.count(rows.columns[0]).alias("n")).collect()}
                lost = s.rows - sum(read.values())
                if lost:
                    # a bucket without rows has no file
                    found += [(table, s.name, name, "unreadable") for name in sorted(listed - set(read))] or [(table, s.name, None, f"{lost} rows missing")]
        return self.spark.createDataFrame(found, "table string, segment long, file string, reason string")


class Store:
    """Tables under ``path``; directories are created when they are first written. Methods that read do so at the newest commit."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path, self.wanted_buckets = spark, path.rstrip("/"), buckets
        self.files = Files(spark, self.path)
        self.commits = Commits(self.files)
        self._known: dict[str, set[int]] = {}

    # --- reading

    def snapshot(self, number: int | None = None) -> Snapshot:
        return Snapshot(self, self.commits.latest() if number is None else self.commits.read(number))

    def table(self, table: str, names: Sequence[int]) -> DataFrame:
        """A table of the session's catalog over the segments, so that buckets are known to the planner."""
        columns, key = TABLES[table]
        name = f"lodestone_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{table}"
        if table not in self._known:
            buckets = f"CLUSTERED BY ({key}) SORTED BY ({', '.join(SORTED.get(table, (key,)))}) INTO {self.buckets()} BUCKETS" if key else ""
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, segment bigint) USING parquet PARTITIONED BY (segment) {buckets} LOCATION '{self.path}/{table}'")
            self._known[table] = set()
        new = [n for n in names if n not in self._known[table]]
        if new:
            parts = " ".join(f"PARTITION (segment={n}) LOCATION '{self.path}/{table}/segment={n}'" for n in new)
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")
            self._known[table].update(new)
        return self.spark.table(name)

    def buckets(self) -> int:
        return self.commits.latest().buckets or self.wanted_buckets or BUCKETS

    def _settle(self, *given: DataFrame) -> None:
        """The buckets of a new store, by the bytes of what is written first. Of several first writers one decides, before any of them writes rows."""
        if not self.commits.latest().buckets:
            self.files.publish("_buckets", str(self.wanted_buckets or max(n_parts(stored_bytes(df), BUCKETS) for df in given)))
            self.wanted_buckets = int(self.files.read("_buckets"))

    def records(self) -> DataFrame:
        return self.snapshot().records()

    def metadata(self) -> DataFrame:
        return self.snapshot().metadata()

    def payloads(self) -> DataFrame:
        return self.snapshot().payloads()

    def payload_sizes(self) -> DataFrame:
        return self.snapshot().payload_sizes()

    def get_record(self, id: str):
        return self.snapshot().get_record(id)

    def exists(self, ids: DataFrame) -> DataFrame:
        return self.snapshot().exists(ids)

    def search_metadata(self, key: str, value: str) -> DataFrame:
        return self.snapshot().search_metadata(key, value)

    def fetch(self, ids: DataFrame) -> DataFrame:
        return self.snapshot().fetch(ids)

    def written_records(self, version: int) -> DataFrame:
        """The records of one version, as they were written."""
        return self.snapshot().segments("records").where(F.col("born") == version).drop("born")

    # --- versions

    def next_version(self) -> int:
        """A version above all that are there; the clock, unless it went back."""
        return max([time.time_ns(), *(v + 1 for v in self.commits.latest().versions())])

    def version_of(self, stream: str, batch: int) -> int:
        """The version of a stream's batch: a new one when it is first seen, and the same when it is delivered again."""
        name = f"batches/stream={stream}/batch={int(batch)}.json"
        if not self.files.system().exists(self.files.path(name)):
            self.files.publish(name, str(self.next_version()))
        return int(self.files.read(name))

    # --- writing

    def _segment(self, df: DataFrame, table: str, version: int, by: str, figures: dict | None = None) -> Segment:
        """Writes a segment, and notes what is seen on the way. What is shuffled for it is deleted once it is there."""
        key, name = TABLES[table][1], time.time_ns()
        at, seen = f"{self.path}/{table}/segment={name}", Observation()
        columns = [c.strip().split(" ")[0] for c in TABLES[table][0].split(", ")] if table != "records" else [*[f.name for f in RECORD.fields], "born"]
        rows = df.select(*columns)
        if key:
            rows = rows.sortWithinPartitions(*SORTED.get(table, (key,)))
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in (figures or {}).items()])
        if key:
            staged = f"lodestone_stage_{uuid.uuid4().hex}"
            # rows lie in their buckets already: a task writes one file
            out = rows.write.format("parquet").bucketBy(self.buckets(), key).option("compression", "zstd").option("path", at)
            if table == "postings":
                out = out.option("parquet.dictionary.page.size", str(DICTIONARY_BYTES))
            else:
                # of a size that fits the file's ids
                out = out.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
            with settings(rows.sparkSession, {TIDY: "true"} | IN_BUCKETS):
                out.saveAsTable(staged)
            self.spark.sql(f"DROP TABLE {staged}")
        else:
            with settings(rows.sparkSession, {TIDY: "true"}):
                rows.write.option("compression", "zstd").parquet(at)
        got = seen.get
        return Segment(name, version, by, got["rows"], self.files.size(f"{table}/segment={name}"), {k: got[k] for k in (figures or {})})

    def _dealt(self, df: DataFrame, key: str) -> DataFrame:
        return df.repartition(self.buckets(), key)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows (id, ...) as the buckets lie, one for each id: ``write`` takes records that are made of them ``dealt``, so what is derived from rows isn't shuffled, also behind a Python function."""
        self._settle(rows)
        return self._dealt(rows, "id").dropDuplicates(["id"])

    def _ranges(self, df: DataFrame, size: int, *keys: str) -> DataFrame:
        """Sorted, in ranges of these columns: as many as ``size`` stored bytes ask for."""
        return df.repartitionByRange(n_parts(size), *keys).sortWithinPartitions(*keys)

    def _commit(self, make: Callable[[Snapshot], Manifest]) -> Manifest:
        """Publishes what ``make`` makes of the newest commit; it is asked again where another writer was quicker."""
        for _ in range(ATTEMPTS):
            base = self.commits.latest()
            new = make(Snapshot(self, base))
            done = self.commits.publish(base, replace(new, buckets=base.buckets or self.wanted_buckets or 0))
            if done:
                return done
        raise ConflictError(f"another writer was quicker {ATTEMPTS} times")

    def _gone(self, now: Snapshot, table: str, ids: DataFrame, version: int, upto: int, by: str) -> dict[str, list[Segment]]:
        """Segments that take the rows of ``ids`` (id) out of count, with what they subtract. Of older rows, narrow columns are read, where they lie."""
        if not now.manifest.of(table):
            return {}
        none, key = F.lit(0).cast("long"), TABLES[table][1]
        old = getattr(now, {"payloads": "segments"}.get(table, table))(**({"table": table} if table == "payloads" else {"born": True}))
        if table == "payloads":
            old = now._counting(old, table, key).where("frame = 0")
        own = {"n_tokens": none, "payload_bytes": none, "compressed_bytes": none, "ratio": F.lit(0.0), "tokens": F.lit(None).cast("array<string>")}
        if table == "records":
            first = F.col("chunk_index") == 0
            own = {"n_tokens": F.size("bm25_tokens").cast("long"), "payload_bytes": F.when(first, F.col("original_size")).otherwise(none), "compressed_bytes": F.when(first, F.col("compressed_size")).otherwise(none), "ratio": ratio(), "tokens": F.col("bm25_tokens")}
        old = old.select(F.col(key).alias("id"), F.lit(upto).cast("long").alias("upto"), *[v.alias(k) for k, v in own.items()])
        # ids go to where the older rows lie, as these have their tokens with them
        hit = old.join(self._dealt(ids.select(F.col("id").alias("__id")), "__id"), F.col("id") == F.col("__id"), "left_semi")
        figures = {"records": F.lit(-1), "tokens": -F.col("n_tokens"), "payload_bytes": -F.col("payload_bytes"), "compressed_bytes": -F.col("compressed_bytes"), "ratio_sum": -F.col("ratio"), "unrated": F.when(F.col("ratio").isNull(), -1)} if table == "records" else None
        made = self._segment(self._dealt(hit, "id"), f"{table}_gone", version, by, figures)
        if not made.rows:
            self.files.delete(f"{table}_gone/segment={made.name}")
            return {}
        return {f"{table}_gone": [made]}

    def _index(self, now: Snapshot, written: Segment | None, gone: list[Segment], version: int, by: str) -> dict[str, list[Segment]]:
        """Postings of a segment of records that was just written, and the differences that it and what is gone make to frequencies."""
        out: dict[str, list[Segment]] = {}
        parts = []
        if written is not None:
            fresh = now.segments("records", [written.name])
            # a token's repetitions lie side by side once rows are sorted as the segment is
            posted = bm25.counted(bm25.flat(fresh).sortWithinPartitions(*SORTED["postings"]))
            posted = posted.withColumn("born", F.lit(written.version).cast("long"))
            out["postings"] = [self._segment(posted, "postings", version, by)]
            parts.append(now.segments("postings", [out["postings"][0].name]).select("token", F.lit(1).alias("d")))
        for s in gone:
            parts.append(now.segments("records_gone", [s.name]).select(F.explode(F.array_distinct("tokens")).alias("token"), F.lit(-1).alias("d")))
        if parts:
            both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            terms = both.groupBy("token").agg(F.sum("d").alias("df")).where("df <> 0")
            out["terms"] = [self._segment(terms.sortWithinPartitions("token"), "terms", version, by)]
        return out

    def write(self, version: int | None = None, records: DataFrame | None = None, metadata: DataFrame | None = None, payloads: DataFrame | None = None, dealt: bool = False) -> int:
        """Upserts records, metadata and payloads by id in one commit. Writing a version again replaces what it had, so a batch that is delivered twice counts once.

        Of rows with one id in a write, one counts. Records that are ``dealt`` are made of what ``dealt`` gave, row by row, and have their ids once. What was written before is not touched; a write that fails leaves nothing that is seen.
        """
        version = self.next_version() if version is None else version
        born = F.lit(version).cast("long").alias("born")
        given: dict[str, DataFrame] = {}
        self._settle(*[df for df in (records, metadata, payloads) if df is not None])
        if records is not None:
            given["records"] = records.select(*[F.col(f.name).cast(f.dataType.simpleString()) for f in RECORD.fields], born)
        if metadata is not None:
            given["metadata"] = metadata.select(F.col("id").cast("string").alias("id"), "metadata", born)
        if payloads is not None:
            one = self._dealt(payloads.select(F.col("payload_id").cast("string").alias("id"), "payload"), "id").dropDuplicates(["id"])
            given["payloads"] = frames(one).select(F.col("id").alias("payload_id"), F.col("chunk_index").alias("frame"), "data", "total_bytes", born)
        first = F.col("chunk_index") == 0
        figures = {"records": F.lit(1), "tokens": F.size("bm25_tokens"), "payload_bytes": F.when(first, F.col("original_size")), "compressed_bytes": F.when(first, F.col("compressed_size")), "ratio_sum": ratio(), "unrated": F.when(ratio().isNull(), 1)}
        made: dict[str, list[Segment]] = {}
        for table, df in given.items():
            key = TABLES[table][1]
            rows = df if table == "payloads" or dealt and table == "records" else self._dealt(df, key).dropDuplicates([key])
            made[table] = [self._segment(rows, table, version, "put", figures if table == "records" else None)]

        def commit(now: Snapshot) -> Manifest:
            again = {t: {s.name for s in now.manifest.of(t) if s.version == version and s.by == "put"} for table in given for t in WITH[table]}
            now = Snapshot(self, now.manifest.without(again))
            if any(s.by == "merge" and s.version >= version for t in again for s in now.manifest.of(t)) and any(s.version == version for t in given for s in self.commits.latest().of(t)):
                raise StorageError(f"version {version} is merged already")
            out = {t: list(own) for t, own in made.items()}
            for table, (s,) in made.items():
                ids = now.segments(table, [s.name]).select(F.col(TABLES[table][1]).alias("id"))
                out |= self._gone(now, table, ids.distinct() if table == "payloads" else ids, version, version - 1, "put")
            if "records" in made:
                out |= self._index(now, made["records"][0], out.get("records_gone", []), version, "put")
            if "metadata" in made:
                fields = string_fields(now.segments("metadata", [made["metadata"][0].name]))
                out["fields"] = [self._segment(self._ranges(fields, made["metadata"][0].size, "key", "value", "id"), "fields", version, "put")]
            return now.manifest.plus(out)

        self._commit(commit)
        self.merge()
        return version

    def put_records(self, records: DataFrame, version: int | None = None) -> int:
        return self.write(version, records=records)

    def put_payloads(self, payloads: DataFrame, version: int | None = None) -> int:
        return self.write(version, payloads=payloads)

    def put_metadata(self, metadata: DataFrame, version: int | None = None) -> int:
        return self.write(version, metadata=metadata)

    def delete(self, ids: DataFrame, version: int | None = None) -> int:
        """Takes records and their metadata out of count; payloads that no record needs any more are not found, and go when the store is compacted."""
        version = self.next_version() if version is None else version
        ids = ids.select(F.col("id").cast("string").alias("id")).distinct()

        def commit(now: Snapshot) -> Manifest:
            out = self._gone(now, "records", ids, version, version, "delete") | self._gone(now, "metadata", ids, version, version, "delete")
            return now.manifest.plus(out | self._index(now, None, out.get("records_gone", []), version, "delete"))

        self._commit(commit)
        return version

    # --- upkeep

    def merge(self) -> bool:
        """Merges index segments of one size class where there are ``FAN`` of them or more; what no longer counts is left out."""
        now = self.snapshot()
        classes: dict[int, list[Segment]] = {}
        for s in now.manifest.of("postings"):
            classes.setdefault(int(math.log(max(s.rows, 1), FAN)), []).append(s)
        own = next((own for _, own in sorted(classes.items()) if len(own) >= FAN), None)
        if own is None:
            return False
        version = max(s.version for s in own)
        names = {s.name for s in own}
        posted = now._counting(now.segments("postings", names), "records")
        made = {"postings": [self._segment(posted, "postings", version, "merge")]}
        # differences may be added up in any order; those of deletes between go along
        low, high = min(s.version for s in own), version
        terms = {s.name for s in now.manifest.of("terms") if low <= s.version <= high}
        summed = now.segments("terms", terms).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
        made["terms"] = [self._segment(summed.sortWithinPartitions("token"), "terms", version, "merge")]

        def commit(latest_: Snapshot) -> Manifest:
            have = {s.name for t in ("postings", "terms") for s in latest_.manifest.of(t)}
            return latest_.manifest.without({"postings": names, "terms": terms}).plus(made) if names | terms <= have else latest_.manifest

        self._commit(commit)
        return True

    def compact(self, table: str | None = None) -> int:
        """Writes what counts of a table (or of all) as one segment, with the index that belongs to it. Payloads that no record refers to go."""
        if table not in (None, *WITH):
            raise StorageError(f"no table {table}")
        version = self.next_version()
        chosen = [table] if table else list(WITH)

        def commit(now: Snapshot) -> Manifest:
            m, out = now.manifest, {}
            for t in chosen:
                if not m.of(t):
                    continue
                rows = now.payload_frames(born=True) if t == "payloads" else getattr(now, t)(born=True)
                made = self._segment(self._dealt(rows, TABLES[t][1]), t, version, "compact")
                out[t] = [replace(made, figures={f: m.total(f) for f in FIGURES} if t == "records" else {})]
            if "records" in out:
                out["postings"] = [self._segment(now._counting(now.segments("postings"), "records"), "postings", version, "compact")]
                out["terms"] = [self._segment(now.frequencies().sortWithinPartitions("token"), "terms", version, "compact")]
            if "metadata" in out:
                out["fields"] = [self._segment(self._ranges(now._counting(now.segments("fields"), "metadata"), sum(s.size for s in m.of("fields")), "key", "value", "id"), "fields", version, "compact")]
            return m.without({t: {s.name for s in m.of(t)} for kind in chosen for t in WITH[kind]}).plus(out)

        self._commit(commit)
        return version

    def vacuum(self, retain_seconds: float = 7 * 86400.0) -> int:
        """Deletes commits older than ``retain_seconds``, but for the newest, and the segments that no commit names any more; how many segments went.

        Segments younger than that stay: a write may be about to publish them. Readers must be done with commits that old.
        """
        before = time.time() - retain_seconds
        kept, number = [], 0
        for number in self.commits.numbers():
            kept.append(self.commits.read(number))
        old = [m for m in kept[:-1] if m.created < before]
        for m in old:
            self.commits.expire(m.number)
        named = {(t, s.name) for m in kept[len(old) :] for t in TABLES for s in m.of(t)}
        gone = 0
        for table in TABLES:
            for folder in self.files.names(table):
                name = folder.partition("segment=")[2]
                if name.isdigit() and (table, int(name)) not in named and int(name) / 1e9 < before:
                    self.files.delete(f"{table}/{folder}")
                    gone += 1
        return gone


__all__ = ["PAYLOAD", "Snapshot", "Store", "frames", "latest", "ratio"]
