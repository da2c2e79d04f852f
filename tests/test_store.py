"""The store under commits: isolation, buckets, index segments, metadata fields, frames, damage, upkeep; streams; answers of models."""

import glob
import os
import re
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from lodestone.operators import bm25
from lodestone.plans.ingest import IngestConfig, ingest
from lodestone.plans.store_queries import record_rows
from lodestone.plans.vault import Vault, VaultConfig, vault_stats
from lodestone.schema import StorageError
from lodestone.sources import answers, store as S
from lodestone.sources.manifest import Commits, ConflictError, Files
from lodestone.sources.shared import PART_BYTES
from lodestone.sources.store import Store
from lodestone.streaming.search_stream import answer
from lodestone.streaming.search_stream import answers as answered
from lodestone.streaming.uploads import only_data, uploads

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *rows):
    return record_rows(spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], DOC))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def scores(now, query):
    tokens = now.spark.createDataFrame([(0, t) for t in query.split()], "qid int, token string")
    return sorted((r.id, r.score) for r in bm25.scores(now.postings(tokens), now.corpus_stats(), tokens, frequencies=now.frequencies(tokens)).collect())


def rebuilt(now, query):
    records = now.records()
    tokens = now.spark.createDataFrame([(0, t) for t in query.split()], "qid int, token string")
    return sorted((r.id, r.score) for r in bm25.scores(bm25.postings(records), bm25.corpus_stats(records), tokens).collect())


def test_index_segments_equal_a_rebuild(spark, tmp_path, monkeypatch):
    """Index, upsert, delete, and a segment merge: scores, frequencies and statistics are those of an index built anew."""
    store = Store(spark, str(tmp_path))
    store.put_records(docs(spark, (1, "alpha beta gamma", "en"), (2, "alpha delta", "fr"), (3, "beta", "en")), 1)
    store.put_records(docs(spark, (2, "epsilon alpha zeta", "en"), (4, "alpha", "de")), 2)
    old = store.snapshot()
    store.delete(spark.createDataFrame([("3",), ("77",)], "id string"), 3)
    now = store.snapshot()
    assert scores(now, "alpha beta") == rebuilt(now, "alpha beta") and {i for i, _ in scores(now, "alpha beta")} == {"1", "2", "4"}
    assert now.corpus_stats().first().n == 3 and scores(now, "delta") == []
    want = {r.token: r.df for r in bm25.document_frequency(bm25.postings(now.records())).collect()}
    assert {r.token: r.df for r in now.frequencies().collect()} == want
    assert [s.rows for s in now.manifest.of("postings")] == [6, 4]  # a write posts its own records only
    monkeypatch.setattr(S, "FAN", 2)
    assert store.merge()
    merged = store.snapshot()
    assert len(merged.manifest.of("postings")) == 1 and merged.manifest.of("postings")[0].rows == 7
    assert scores(merged, "alpha beta") == scores(now, "alpha beta") and {r.token: r.df for r in merged.frequencies().collect()} == want
    assert {i for i, _ in scores(old, "beta")} == {"1", "3"}
    with pytest.raises(StorageError, match="merged"):
        store.put_records(docs(spark, (1, "again", "en")), 2)


def test_reads_do_not_shuffle_records(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    store.put_records(docs(spark, *[(i, f"text {i}", "en") for i in range(40)]), 1)
    store.put_records(docs(spark, *[(i, f"text {i} new", "en") for i in range(0, 40, 2)]), 2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.sources.bucketing.autoBucketedScan.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        now = store.snapshot()
        assert "Exchange" not in plan(now.records()) and "SortMergeJoin" in plan(now.records()) and now.records().count() == 40
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        assert "SelectedBucketsCount: 1 out of 4" in plan(now.lookup(["7"])) and now.get_record("8").summary == "text 8 new"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_readers_keep_their_commit(spark, tmp_path):
    """A reader that began before an upsert, a failed write, a delete, a compaction and a vacuum sees the same rows."""
    store = Store(spark, str(tmp_path))
    store.write(1, docs(spark, (1, "one", "en"), (2, "two", "fr")))
    before = store.snapshot()
    broken = docs(spark, (3, "three", "en")).withColumn("summary", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.put_records(broken, 2)
    assert store.snapshot().manifest.number == 1 and ids(store.records()) == ["1", "2"]
    store.put_records(docs(spark, (2, "two again", "fr")), 3)
    store.delete(spark.createDataFrame([("1",)], "id string"), 4)
    store.compact()
    assert store.vacuum() == 0  # nothing is old enough
    assert sorted(r.summary for r in before.records().collect()) == ["one", "two"] and [r.summary for r in store.records().collect()] == ["two again"]
    assert store.vacuum(retain_seconds=0) > 0 and [r.summary for r in store.records().collect()] == ["two again"] and scores(store.snapshot(), "again")[0][0] == "2"
    assert store.snapshot().stats().first().total_records == 1


def test_writers_that_began_together(spark, tmp_path, monkeypatch):
    """Of two writers at one commit, the second begins anew, and sees what the first wrote; a name is given once."""
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    store.put_records(docs(spark, (1, "one", "en")), 1)
    quicker = iter([True])
    publish = Commits.publish

    def late(self, base, new):
        if self is store.commits and next(quicker, False):
            other.put_records(docs(spark, (1, "quicker", "en"), (2, "two", "en")), 2)
        return publish(self, base, new)

    monkeypatch.setattr(Commits, "publish", late)
    store.put_records(docs(spark, (1, "later", "en")), 3)
    assert sorted((r.id, r.summary) for r in store.records().collect()) == [("1", "later"), ("2", "two")]
    assert store.snapshot().corpus_stats().first().n == 2 and scores(store.snapshot(), "quicker") == []
    monkeypatch.setattr(Commits, "publish", lambda self, base, new: None)
    with pytest.raises(ConflictError):
        store.put_records(docs(spark, (9, "never", "en")), 4)
    files = Files(spark, str(tmp_path / "x"))
    assert files.publish("a", "1") and not files.publish("a", "2") and files.read("a") == "1" and files.names("") == ["a"] or files.read("a") == "1"


def test_metadata_fields(spark, tmp_path):
    rows = [("a", '{"k":"x","n":1,"o.p":"q"}'), ("b", '{"k":"y"}'), ("c", '{"k":1}'), ("d", "no json"), ("e", None), ("f", '["k"]'), ("g", '{"k":"x"}')]
    store = Store(spark, str(tmp_path))
    store.put_metadata(spark.createDataFrame(rows, "id string, metadata string"), 1)
    assert ids(store.search_metadata("k", "x")) == ["a", "g"] and ids(store.search_metadata("o.p", "q")) == ["a"] and ids(store.search_metadata("k", "1")) == []
    store.put_metadata(spark.createDataFrame([("a", '{"k":"z"}')], "id string, metadata string"), 2)
    assert ids(store.search_metadata("k", "x")) == ["g"] and ids(store.search_metadata("k", "z")) == ["a"]
    assert "PushedFilters: [" in plan(store.search_metadata("k", "x")) and "EqualTo(key,k)" in plan(store.search_metadata("k", "x"))
    store.compact("metadata")
    assert ids(store.search_metadata("k", "x")) == ["g"] and store.metadata().count() == len(rows)


def test_payload_frames_and_collection(spark, tmp_path, monkeypatch):
    """Ranges of payloads of several frames; payloads whose records are gone leave the disk, others stay whole."""
    monkeypatch.setattr(S, "FRAME_BYTES", 10)
    monkeypatch.setattr(S.frames, "__defaults__", (10,))
    store = Store(spark, str(tmp_path))
    blobs = {"1": bytes(range(35)), "2": b"", "3": b"0123456789"}
    store.write(1, docs(spark, (1, "one", "en"), (2, "two", "en"), (3, "three", "fr")), None, spark.createDataFrame(list(blobs.items()), "payload_id string, payload binary"))
    now = store.snapshot()
    assert {r.payload_id: bytes(r.payload) for r in now.payloads().collect()} == blobs
    assert {r.payload_id: r["size"] for r in now.payload_sizes().collect()} == {"1": 35, "2": 0, "3": 10}
    asked = spark.createDataFrame([("1",), ("1",), ("no",)], "id string")
    for start, stop in ((0, None), (0, 10), (5, 25), (9, 11), (30, 99), (20, 20)):
        got = sorted((r.chunk_index, bytes(r.data), r.total_bytes) for r in now.fetch_range(asked, start, stop).collect())
        assert b"".join(d for _, d, _ in got) == blobs["1"][start:stop] and all(n == 35 for *_, n in got)
        assert len(got) <= -(-(35 if stop is None else max(stop, 1)) // 10) - start // 10
    store.put_payloads(spark.createDataFrame([("3", b"new")], "payload_id string, payload binary"), 2)
    assert bytes(store.payloads().where("payload_id = '3'").first().payload) == b"new"
    store.delete(spark.createDataFrame([("1",)], "id string"), 3)
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/payloads/**/*.parquet", recursive=True))
    full = size()
    store.compact()
    store.vacuum(retain_seconds=0)
    assert size() < full and {r.payload_id: bytes(r.payload) for r in store.payloads().collect()} == {"2": b"", "3": b"new"}


def test_damaged_files_are_set_aside(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    store.put_records(docs(spark, *[(i, f"text {i}", "en") for i in range(30)]), 1)
    assert store.snapshot().damaged().count() == 0
    broken = sorted(glob.glob(f"{tmp_path}/records/segment=*/*.parquet"))[0]
    data = open(broken, "rb").read()
    lost = spark.read.parquet(broken).count()
    with open(broken, "wb") as f:
        f.write(data[: len(data) // 2])
    for crc in glob.glob(f"{tmp_path}/records/segment=*/.*.crc"):
        os.remove(crc)
    found = store.snapshot().damaged().collect()
    assert [(r.table, r.file, r.reason) for r in found] == [("records", os.path.basename(broken), "unreadable")]
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        assert Store(spark, str(tmp_path)).records().count() == 30 - lost
    finally:
        spark.conf.set("spark.sql.files.ignoreCorruptFiles", "false")


def test_figures_come_from_commits(spark, tmp_path):
    vault = Vault(spark, str(tmp_path), VaultConfig(ingest=IngestConfig(chunk_words=10, overlap_words=2, dim=4)))
    files = spark.createDataFrame([(str(i), f"{i}.txt", (f"word{i} " * 30).encode(), "hybrid_file", "{}", None) for i in range(4)], "file_id string, filename string, content binary, storage_mode string, metadata string, parent_id string")
    vault.ingest(files)
    vault.ingest(files.where("file_id < 2"))
    gone = vault.store.records().where("filename = '3.txt'").select("id")
    vault.delete(gone)
    stats, records = vault.stats().first(), vault.store.records().collect()
    first = [r for r in records if r.chunk_index == 0]
    assert stats.total_records == len(records) and stats.total_payload_bytes == sum(r.original_size for r in first) and stats.total_compressed_bytes == sum(r.compressed_size for r in first)
    assert stats.avg_compression_ratio == pytest.approx(sum(r.compression_ratio for r in records) / len(records), abs=1e-5) and stats.index_size > 0
    assert "FileScan" not in plan(vault.store.snapshot().stats())


def test_mean_ratio_is_that_of_the_sizes(spark, tmp_path):
    """141 / 71 as FLOAT rounds to another sixth digit; a record whose size isn't known has no ratio, an empty one has 1."""
    store = Store(spark, str(tmp_path))
    store.put_records(docs(spark, (1, "x" * 141, "en"), (2, "y" * 141, "en")), 1)
    unknown = record_rows(spark.createDataFrame([(3, None, "en", "s", None)], DOC))
    store.put_records(unknown.unionByName(docs(spark, (2, "z" * 141, "en"), (4, "", "en"))), 2)
    means = lambda: [x.first().avg_compression_ratio for x in (store.snapshot().stats(), vault_stats(store.records()))]
    assert store.snapshot().stats().first().total_records == 4 and means() == [round((2 * 141 / 71 + 1) / 3, 6)] * 2
    for i, want in (("4", round(141 / 71, 6)), ("3", round(141 / 71, 6)), ("1", round(141 / 71, 6)), ("2", 0.0)):
        store.delete(spark.createDataFrame([(i,)], "id string"))
        assert means() == [want] * 2


PARTS = "upload_id string, filename string, chunk_index int, total_chunks int, data binary"


def test_upload_stream(spark, tmp_path):
    """Parts out of order, repeated, across batches and a restart; parts that contradict; an upload that is given up."""
    source = tmp_path / "parts"

    def arrive(*rows):
        spark.createDataFrame([(u, f"{u}.txt", i, n, d) for u, i, n, d in rows], PARTS).coalesce(1).write.mode("append").parquet(str(source))

    def run(timeout_ms=3_600_000):
        stream = spark.readStream.schema(PARTS).option("maxFilesPerTrigger", 1).parquet(str(source))
        out = uploads(stream, timeout_ms, most_bytes=100).writeStream.outputMode("append").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}"))
        with only_data(spark):
            out.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.file_id, r.filename, r.content and bytes(r.content), r.error) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    arrive(("a", 2, 3, b"c"), ("b", 0, 1, b"whole"), ("c", 0, 2, b"x"), ("d", 5, 2, b"x"), ("e", 0, 2, b"x" * 101))
    arrive(("a", 0, 3, b"a"), ("a", 2, 3, b"c"), ("b", 0, 1, b"whole"), ("f", 0, 2, b"x"))
    first = run()
    assert first == [("b", "b.txt", b"whole", None), ("d", "d.txt", None, "part 5 of 2 does not fit an upload of 2 parts"), ("e", "e.txt", None, "more than 100 bytes")]
    arrive(("a", 1, 3, b"b"), ("c", 0, 2, b"y"))
    assert run() == sorted([*first, ("a", "a.txt", b"abc", None), ("c", "c.txt", None, "part 0 came twice with other bytes")], key=lambda r: r[0])
    arrive(("a", 1, 3, b"b"))
    assert len(run()) == 5


def test_search_stream_answers_once(spark, tmp_path):
    """Answers are those of the batch search at the pinned commit, also after the store moved on, a restart and a batch that comes again."""
    vault = Vault(spark, str(tmp_path / "vault"), VaultConfig(ingest=IngestConfig(dim=8, embedding="hashing")))
    vault.store.put_records(docs(spark, (1, "alpha beta", "en"), (2, "gamma", "en")).withColumn("embedding", F.array_repeat(F.lit(0.5).cast("float"), 8)), 1)
    ask = lambda *rows: spark.createDataFrame(list(rows), "qid long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "asked"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: answer(vault, spark.readStream.schema("qid long, text string").parquet(str(tmp_path / "asked")), out, check, 3).awaitTermination(120)
    ask((1, "alpha"))
    assert run()
    vault.store.put_records(docs(spark, (3, "alpha alpha", "en")).withColumn("embedding", F.array_repeat(F.lit(0.5).cast("float"), 8)), 2)
    os.remove(sorted(glob.glob(f"{check}/commits/[0-9]*"))[-1])  # as if the stream had died before it noted the batch
    for crc in glob.glob(f"{check}/commits/.*.crc"):
        os.remove(crc)
    ask((2, "gamma"))
    assert run()
    pinned = vault.store.snapshot(1)
    want = vault.search_batch(spark.createDataFrame([(1, "alpha"), (2, "gamma")], "qid long, text string"), 3, index=pinned)
    shown = lambda df: sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())
    assert shown(answered(vault, out)) == shown(want) and all(r[2] != "3" for r in shown(want))


def test_models_are_asked_once_for_a_content(spark, tmp_path):
    """One call for each distinct prompt, failures of their own rows only, and asked again; final errors are not tried twice; the rate is kept."""
    (tmp_path / "calls").mkdir()

    def model(kind, text, where=str(tmp_path / "calls")):
        import uuid

        with open(f"{where}/{uuid.uuid4().hex}", "w") as f:
            f.write(text)
        if text.startswith("bad"):
            raise answers.FinalError("no") if text == "bad for good" else ValueError("busy")
        return f"{kind}:{text}"

    asked = spark.createDataFrame([(i, "k", t) for i, t in enumerate(["one", "one", "two", "bad", "bad for good", None])], "i int, __kind string, __about string")
    calls, table = answers.Calls(attempts=2, pause=0.0, concurrency=3), str(tmp_path / "kept")
    made = lambda: [open(f).read() for f in glob.glob(f"{tmp_path}/calls/*")]
    got = {r.i: (r.answer, r.error) for r in answers.ask(asked, model, "string", calls, table).collect()}
    assert got == {0: ("k:one", None), 1: ("k:one", None), 2: ("k:two", None), 3: (None, "Provider error: busy"), 4: (None, "Provider error: no"), 5: ("k:", None)}
    assert sorted(made()) == ["", "bad", "bad", "bad for good", "one", "two"]
    assert {r.i: r.answer for r in answers.ask(asked, model, "string", calls, table).collect()} == {i: a for i, (a, _) in got.items()}
    assert sorted(made()).count("one") == 1 and made().count("bad") == 4


def test_failed_rows_go_aside(spark, tmp_path):
    def model(prompt, text):
        if "bad" in text:
            raise ValueError("busy")
        return text.upper()

    config = IngestConfig(dim=4, summarizer=model, attempts=1, pause=0.0, on_error="skip")
    files = spark.createDataFrame([("a", "a.txt", b"good", "text_only", "{}", None), ("b", "b.txt", b"bad", "text_only", "{}", None)], "file_id string, filename string, content binary, storage_mode string, metadata string, parent_id string")
    records, _ = ingest(files, config, str(tmp_path / "answers"))
    assert [r.summary for r in records.collect()] == ["GOOD"]
    assert [(r.file_id, r.error) for r in spark.read.parquet(f"{tmp_path}/answers/failures").collect()] == [("b", "Provider error: busy")]


def test_search_embeds_its_text(spark, tmp_path):
    """The vector arm of a search by text finds what was embedded alike; a model's failure leaves the text arm."""
    config = IngestConfig(dim=2, embedder=lambda s: [1.0, 0.0] if "cat" in s or "feline" in s else [0.0, 1.0], attempts=1, pause=0.0)
    vault = Vault(spark, str(tmp_path), VaultConfig(ingest=config))
    files = spark.createDataFrame([(str(i), f"{i}.txt", t.encode(), "text_only", "{}", None) for i, t in enumerate(["a cat sat", "a dog ran", "a dog sat"])], "file_id string, filename string, content binary, storage_mode string, metadata string, parent_id string")
    vault.ingest(files)
    assert vault.search("feline", weight=1.0, k=1).first().summary.endswith("a cat sat")

    def broken(text):
        raise ValueError("busy")

    lame = Vault(spark, str(tmp_path), VaultConfig(ingest=IngestConfig(dim=2, embedder=broken, attempts=1, pause=0.0)))
    assert lame.search("dog ran", weight=0.0, k=1).first().summary.endswith("a dog ran")


# --- growth: tasks get more, not larger -----------------------------------------------------------------------------

ROWS = [(1, "first words here", "en"), (2, "second words", "fr"), (3, "third text", "en")]


def test_a_large_first_write_makes_more_buckets_and_later_ones_keep_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestone.sources.store.stored_bytes", lambda df: 20 * PART_BYTES)
    store = Store(spark, str(tmp_path))
    store.put_records(docs(spark, *ROWS), 1)
    assert store.snapshot().manifest.buckets == 20
    monkeypatch.setattr("lodestone.sources.store.stored_bytes", lambda df: 90 * PART_BYTES)
    other = Store(spark, str(tmp_path))
    other.write(2, record_rows(other.dealt(spark.createDataFrame([(9, "late words", "en", "s", 10, "9")], f"{DOC}, id string"))), dealt=True)
    assert other.snapshot().manifest.buckets == 20
    assert sorted(r.id for r in other.records().collect()) == sorted({str(i) for i, *_ in ROWS} | {"9"})


def test_of_two_first_writers_one_decides_on_buckets(spark, tmp_path):
    one, two = Store(spark, str(tmp_path), buckets=3), Store(spark, str(tmp_path), buckets=5)
    rows = docs(spark, *ROWS)
    one.dealt(rows)
    two.put_records(rows, 1)
    one.put_records(rows, 2)
    assert (one.buckets(), two.buckets()) == (3, 3) and one.records().count() == len({i for i, *_ in ROWS})


def test_postings_are_shuffled_once_and_rows_of_one_id_are_counted_together(spark):
    rows = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["x"]), ("b", ["x"])], "id string, bm25_tokens array<string>")
    made = bm25.sorted_postings(rows, 3)
    assert sorted((r.token, r.id, r.tf) for r in made.collect()) == [("x", "a", 2), ("x", "b", 2), ("y", "a", 1)]
    assert plan(made).split("Initial Plan")[-1].count("Exchange ") == 1


def test_index_counts_repeated_tokens_of_a_record(spark, tmp_path):
    rows = docs(spark, (1, "kept once", "en"), (2, "again", "en")).withColumn("bm25_tokens", F.when(F.col("id") == "1", F.array(F.lit("twice"), F.lit("twice"), F.lit("once"))).otherwise(F.array(F.lit("once"))))
    store = Store(spark, str(tmp_path))
    store.put_records(rows, 1)
    assert sorted((r.token, r.id, r.tf, r.doc_len) for r in store.snapshot().postings().collect()) == [("once", "1", 1, 3), ("once", "2", 1, 1), ("twice", "1", 2, 3)]


def test_a_write_shuffles_texts_once_and_postings_never(spark, tmp_path, monkeypatch):
    """Also behind the Python function that packs embeddings. Of files with one id, one counts."""
    seen = {}

    def noted(self, df, table, *more):
        seen.setdefault(table, plan(df).split("Initial Plan")[-1].count("Exchange "))
        return segment(self, df, table, *more)

    segment = Store._segment
    monkeypatch.setattr(Store, "_segment", noted)
    vault = Vault(spark, str(tmp_path), VaultConfig(ingest=IngestConfig(chunk_words=10, overlap_words=2, dim=4)))
    files = spark.createDataFrame([(str(i // 2), f"{i}.txt", b"one two three", "hybrid_file", "{}", None) for i in range(4)], "file_id string, filename string, content binary, storage_mode string, metadata string, parent_id string")
    vault.ingest(files)
    assert seen["records"] == 1 and seen["postings"] == 0 and vault.store.records().count() == 2
    assert sorted((r.token, r.tf) for r in vault.index().postings().collect()) == sorted([(t, 1) for t in ("mock", "summary", "one", "two", "three")] * 2)


def test_shuffle_files_of_a_write_are_deleted(spark, tmp_path):
    kept = lambda: {f.getPath() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in f.getName()}
    rows = docs(spark, *[(i, f"alpha beta{i}", "en") for i in range(200)])
    before = kept()
    Store(spark, str(tmp_path)).put_records(rows, 1)
    for _ in range(50):
        if not kept() - before:
            break
        time.sleep(0.2)
    assert not kept() - before


def test_scores_are_added_up_in_the_buckets_of_records(spark, tmp_path):
    """Rows of postings and partial scores stay where their records lie, also without what a later version replaced."""
    store = Store(spark, str(tmp_path))
    store.put_records(docs(spark, (1, "alpha beta", "en"), (2, "alpha delta", "fr"), (3, "beta", "en")), 1)
    store.put_records(docs(spark, (2, "epsilon alpha", "en")), 2)
    now, tokens = store.snapshot(), spark.createDataFrame([(0, "alpha"), (1, "beta")], "qid int, token string")
    made = bm25.scores(now.postings(tokens), now.corpus_stats(), tokens, frequencies=now.frequencies(tokens))
    assert "Exchange hashpartitioning(qid" not in plan(made)
    assert scores(now, "alpha beta") == rebuilt(now, "alpha beta")


def test_a_write_sorts_its_rows_once(spark, tmp_path, monkeypatch):
    """What is one row an id lies sorted for its bucket already; postings are made in one scan and one sort, and counted in passing. Files keep their order, one a bucket."""
    seen, save = [], DataFrameWriter.saveAsTable

    def noted(self, name, *more):
        seen.append((plan(self._df), spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        return save(self, name, *more)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", noted)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    store = Store(spark, str(tmp_path), buckets=3)
    rows = spark.createDataFrame([(i, f"word{i % 7} word{i % 5} same", "en", "s", 9, str(i)) for i in (*range(60), 7)], f"{DOC}, id string")
    repeated = F.when(F.col("id") == "7", F.array(*[F.lit(x) for x in "baba"])).otherwise(F.col("bm25_tokens"))
    store.write(1, record_rows(store.dealt(rows)).withColumn("bm25_tokens", repeated), dealt=True)
    (records, open_writers), (postings, _) = seen
    assert len(re.findall(r"\bSort \[", records)) == 1 and open_writers == "1" and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert [len(re.findall(x, postings)) for x in (r"\bSort \[", "FileScan", "SortAggregate", "HashAggregate", "Union")] == [1, 1, 1, 0, 0]
    for table, columns in (("records", ["id"]), ("postings", ["token", "id"])):
        files = glob.glob(f"{tmp_path}/{table}/segment=*/*.parquet")
        assert len({re.search(r"_(\d+)\.", f)[1] for f in files}) == len(files) <= 3
        for f in files:
            read = [tuple(r.values()) for r in pq.read_table(f, columns=columns).to_pylist()]
            assert read == sorted(read)
    now = store.snapshot()
    assert sorted((r.token, r.tf, r.doc_len) for r in now.postings().where("id = '7'").collect()) == [("a", 2, 4), ("b", 2, 4)]
    assert scores(now, "word3 same a") == rebuilt(now, "word3 same a") and now.records().count() == 60


def test_a_few_tokens_are_named_in_the_scan(spark, tmp_path):
    """Up to as many as Parquet takes one by one; more are joined. Null, unknown, repeated tokens and none at all find what they found."""
    store = Store(spark, str(tmp_path), buckets=2)
    store.put_records(docs(spark, *[(i, f"alpha word{i} word{i + 1}", "en") for i in range(30)]), 1)
    store.put_records(docs(spark, (3, "alpha late", "en")), 2)
    now, few = store.snapshot(), int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold"))
    ask = lambda *names: spark.createDataFrame([(n,) for n in names], "token string")
    for names in (["alpha", "word3", "late", "alpha", None, "unknown"], [], [None], [f"word{i}" for i in range(few)], [f"word{i}" for i in range(few + 1)], ["alpha", None, *[f"word{i}" for i in range(few + 5)]]):
        tokens = ask(*names)
        for found, all_ in ((now.postings(tokens), now.postings()), (now.frequencies(tokens), now.frequencies())):
            assert sorted(map(tuple, found.collect())) == sorted(tuple(r) for r in all_.collect() if r.token in set(names) - {None})
        named = len(set(names) - {None}) <= few
        assert ("LeftSemi" not in plan(now.frequencies(tokens))) == named
    assert all("In(token, [" in plan(x) for x in (now.postings(ask("alpha", "late")), now.frequencies(ask("alpha", "late"))))
