"""Store, ingest, streaming, facade and command line."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.cli import main
from lodestone.functions.codec import decompress_bytes
from lodestone.plans.ingest import IngestConfig, hashing_embedding, ingest, validate
from lodestone.plans.vault import Vault, VaultConfig
from lodestone.schema import IngestError, InvalidInputError, NotFoundError, ProviderError
from lodestone.sources.extract import NO_OCR, NO_TEXT, Providers, docx_markup, extract_text, with_retry
from lodestone.sources.store import Store, frames
from lodestone.streaming.stream_ingest import assemble_uploads, into_store, watch

FILES = "file_id string, filename string, content binary, storage_mode string, metadata string, parent_id string"


def files(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], FILES)


def config(**options):
    return IngestConfig(chunk_words=10, overlap_words=2, dim=16, embedding="hashing", **options)


def test_ingest(spark):
    long = b"One two three four five six. Seven eight nine ten eleven twelve. Thirteen fourteen."
    records, payloads = ingest(files(spark, ("a", "a.txt", b"hello world", "hybrid_file", '{"k":"x"}'), ("b", "b.md", long, "FULL_RAW"), ("c", "c.txt", b"bytes", "text_only"), ("d", None, None)), config())
    rows = sorted(records.collect(), key=lambda r: (r.filename, r.chunk_index))
    assert [(r.filename, r.chunk_index, r.total_chunks) for r in rows] == [("", 0, 1), ("a.txt", 0, 1), ("b.md", 0, 2), ("b.md", 1, 2), ("c.txt", 0, 1)]
    assert rows[1].summary == "mock summary for: hello world" and rows[1].bm25_tokens == ["mock", "summary", "hello", "world"]
    assert rows[2].parent_id == rows[3].parent_id and rows[1].parent_id is None
    assert rows[4].compression_ratio == 0.0 and rows[4].compressed_size == 0
    held = {r.payload_id: bytes(r.payload) for r in payloads.collect()}
    assert set(held) == {rows[1].id, rows[2].parent_id}
    assert decompress_bytes(held[rows[2].parent_id], "lzma", len(long)) == long
    again, _ = ingest(files(spark, ("a", "a.txt", b"hello world", "hybrid_file")), config())
    assert again.first().id == rows[1].id


def test_remote_models_are_called_and_checked(spark):
    made, _ = ingest(files(spark, ("a", "a.txt", b"text")), config(summarizer=lambda p, t: t.upper(), embedder=lambda s: [1.0] * 16))
    row = made.first()
    assert row.summary == "TEXT" and list(row.embedding) == [1.0] * 16
    bad, _ = ingest(files(spark, ("a", "a.txt", b"text")), config(embedder=lambda s: [1.0], pause=0))
    with pytest.raises(Exception, match="1 values, not 16"):
        bad.collect()


def test_retry():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("busy")
        return "ok"

    assert with_retry(flaky, 3, 0) == "ok"
    with pytest.raises(ProviderError, match="Provider error: busy"):
        with_retry(lambda: (_ for _ in ()).throw(ValueError("busy")), 2, 0)


def test_validate(spark):
    rows = spark.createDataFrame([("text_only", "{}", ""), ("nope", "{}", ""), ("full_raw", "{", ""), ("full_raw", "", "x")], "storage_mode string, metadata string, parent_id string")
    assert [r.error for r in validate(rows).collect()] == [None, "Invalid input: Unknown storage mode: nope", "Invalid input: metadata is no JSON", "Invalid input: parent_id is no UUID"]
    rows = spark.createDataFrame([("FULL_RAW", "Text", b"12345678", [1.0]), (None, "text", None, None), ("full_raw", "film", None, None), ("full_raw", None, b"123", None), ("full_raw", "", b"1234", None), ("full_raw", "", None, [1.0, 2.0])], "storage_mode string, modality string, embedding_bytes binary, embedding array<float>")
    assert [r.error for r in validate(rows).collect()] == [None, "Invalid input: Unknown storage mode: null", "Invalid input: Unknown modality: film", "Invalid input: embedding bytes are no whole floats", None, None]
    assert [r.error for r in validate(rows, 2).collect()][0] == "Invalid input: embedding has 1 values, not 2" and [r.error for r in validate(rows, 2).collect()][4:] == ["Invalid input: embedding has 1 values, not 2", None]


def test_extractors(spark):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("word/document.xml", "<w:p>Hello <w:b>there</w:b></w:p>")
    rows = [("1", "a.docx", "document", box.getvalue()), ("2", "a.txt", "text", b"ok \xff"), ("3", "i.png", "image", b"i"), ("4", "v.mp4", "video", b"v"), ("5", "v.ts", "video", b"v"), ("6", "s.mp3", "audio", b"s"), ("7", "p.pdf", "document", b"%PDF plain")]
    df = spark.createDataFrame(rows, "file_id string, filename string, modality string, content binary")
    bare = {r.file_id: r.text for r in extract_text(df).collect()}
    assert bare["1"] == "Hello there" and bare["2"] == "ok �" and bare["3"] == NO_OCR and bare["7"] == "%PDF plain" and bare["4"] == bare["6"] == ""
    models = Providers(ocr=lambda c, n: "tiny", caption=lambda c, n: "cap", transcribe=lambda c, n: "said", frames=lambda c, n: [b"1", b"2"])
    full = {r.file_id: r.text for r in extract_text(df, models).collect()}
    assert full["3"] == f"{NO_TEXT} cap" and full["4"] == "[Visual]: cap | cap [Audio]: said" and full["5"] == "cap" and full["6"] == "said"
    with pytest.raises(IngestError):
        docx_markup(b"no archive")


def test_frames(spark):
    df = spark.createDataFrame([("a", b"0123456789"), ("b", b""), ("c", b"01234")], "id string, payload binary")
    got = sorted((r.id, r.chunk_index, bytes(r.data), r.total_bytes) for r in frames(df, 5).collect())
    assert got == [("a", 0, b"01234", 10), ("a", 1, b"56789", 10), ("b", 0, b"", 0), ("c", 0, b"01234", 5)]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.records().count() == 0 and store.payloads().count() == 0
    records, payloads = ingest(files(spark, ("a", "a.txt", b"alpha", "full_raw", '{"k":"x"}'), ("b", "b.txt", b"beta", "full_raw", '{"k":1}')), config())
    store.put_records(records, 1)
    store.put_payloads(payloads, 1)
    store.put_metadata(records.select("id", "metadata"), 1)
    ids = {r.filename: r.id for r in store.records().collect()}
    store.put_records(records.withColumn("summary", F.lit("new")).where("filename = 'a.txt'"), 2)
    assert store.get_record(ids["a.txt"]).summary == "new" and store.records().count() == 2
    store.put_records(records.withColumn("summary", F.lit("newer")).where("filename = 'a.txt'"), 2)
    assert store.get_record(ids["a.txt"]).summary == "newer"
    assert [r.id for r in store.search_metadata("k", "x").collect()] == [ids["a.txt"]] and store.search_metadata("k", "1").count() == 0
    asked = spark.createDataFrame([(ids["a.txt"],), ("no",)], "id string")
    assert {r.id: r.found for r in store.exists(asked).collect()} == {ids["a.txt"]: True, "no": False}
    assert store.payload_sizes().count() == 2
    store.delete(spark.createDataFrame([(ids["b.txt"],)], "id string"), 3)
    assert store.records().count() == 1 and store.payloads().count() == 1 and store.metadata().count() == 1
    store.compact("records")
    assert store.records().count() == 1
    with pytest.raises(NotFoundError):
        store.get_record(ids["b.txt"])
    assert Store(spark, str(tmp_path)).records().count() == 1


def test_vault(spark, tmp_path):
    vault = Vault(spark, str(tmp_path), VaultConfig(ingest=config()))
    assert vault.ping() == "pong"
    texts = ["Rust is a memory efficient language", "Python is easy to learn", "Go has goroutines", "Java runs everywhere", "C is close to the metal"]
    vault.ingest(files(spark, *[(str(i), f"{i}.txt", t.encode(), "hybrid_file", '{"n":"%d"}' % (i % 2)) for i, t in enumerate(texts)]))
    hits = vault.search("memory-efficient language", weight=0.0, k=3).collect()
    assert len(hits) == 3 and "Rust" in hits[0].summary and hits[0].has_payload and hits[0].score == pytest.approx(1 / 61)
    assert [h["rank"] for h in hits] == [1, 2, 3]
    query = spark.range(1).select(hashing_embedding(F.array(F.lit("goroutines"), F.lit("mock"), F.lit("summary")), 16).alias("v")).first().v
    assert "goroutines" in vault.search(embedding=list(query), weight=1.0, k=5).collect()[0].summary
    assert all('"0"' in h.metadata for h in vault.search("language", filters={"n": "0"}, k=5).collect())
    assert vault.search("language", modality="image").count() == 0
    index = vault.index()
    assert vault.search("memory", weight=0.0, k=1, index=index).first().summary.endswith("memory efficient language")
    some = hits[0].id
    assert vault.fetch(some, unpack=True) == texts[0].encode() and vault.fetch(some) != texts[0].encode()
    stats = vault.stats().first()
    assert stats.total_records == 5 and stats.total_payload_bytes == sum(map(len, texts))
    gone = spark.createDataFrame([(some,)], "id string")
    assert vault.delete(gone) == 1 and vault.stats().first().total_records == 4
    with pytest.raises(NotFoundError):
        vault.delete(gone)


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.txt").write_text(f"text number {i}")
    store = Store(spark, str(tmp_path / "vault"))
    run = lambda: into_store(watch(spark, str(source)), store, str(tmp_path / "check"), config()).awaitTermination(120)
    assert run() and store.records().count() == 3
    (source / "3.txt").write_text("later")
    assert run() and store.records().count() == 4
    parts = spark.createDataFrame([("u", "f.txt", 1, b"lo"), ("u", "f.txt", 0, b"hel"), ("u", "f.txt", 1, b"lo")], "upload_id string, filename string, chunk_index int, data binary")
    assert bytes(assemble_uploads(parts).first().content) == b"hello"


def test_streams_and_the_facade_share_versions(spark, tmp_path):
    """What comes later counts, whether a stream or the facade wrote it; no stream overwrites another; a batch that comes again does nothing new."""
    vault = Vault(spark, str(tmp_path / "vault"), VaultConfig(ingest=config()))
    stream = lambda name: into_store(watch(spark, str(tmp_path / name)), vault.store, str(tmp_path / f"check-{name}"), config()).awaitTermination(120)
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
    (tmp_path / "one" / "a.txt").write_text("new")
    path = (tmp_path / "one" / "a.txt").as_uri().replace("file:///", "file:/")
    vault.ingest(files(spark, (path, "a.txt", b"old")))
    assert stream("one")
    assert [r.summary for r in vault.store.records().collect()] == ["mock summary for: new"]
    (tmp_path / "two" / "b.txt").write_text("second stream")
    assert stream("two") and vault.store.records().count() == 2
    vault.delete(vault.store.records().where("filename = 'a.txt'").select("id"))
    (tmp_path / "one" / "c.txt").write_text("third")
    assert stream("one") and {r.filename for r in vault.store.records().collect()} == {"b.txt", "c.txt"}
    vault.store.compact("records")
    (tmp_path / "two" / "d.txt").write_text("after")
    assert stream("two") and vault.store.records().count() == 3
    assert vault.store.version_of("s", 0) == vault.store.version_of("s", 0) < vault.store.version_of("s", 1) < vault.store.next_version()


def test_models_are_asked_once(spark, tmp_path):
    (tmp_path / "asked").mkdir()

    def summarizer(prompt, text, where=str(tmp_path / "asked")):
        import uuid

        open(f"{where}/{uuid.uuid4().hex}", "w").close()
        return f"summary {uuid.uuid4().hex}"

    vault = Vault(spark, str(tmp_path / "vault"), VaultConfig(ingest=config(summarizer=summarizer)))
    vault.ingest(files(spark, ("a", "a.txt", b"alpha", "full_raw", '{"k":"x"}')))
    assert len(list((tmp_path / "asked").iterdir())) == 1 and vault.store.metadata().count() == vault.store.records().count() == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "f.txt").write_text("a file about lanterns")
    where = ["--path", str(tmp_path / "v"), "--dim", "8"]
    assert main([*where, "ingest", str(tmp_path / "f.txt")]) == 0
    for command in (["ping"], ["stats"], ["config"], ["search", "lanterns", "--weight", "0"]):
        assert main([*where, *command]) == 0
    assert "lanterns" in capsys.readouterr().out


def test_settings_in_layers(tmp_path):
    """Defaults, files in their order, the environment; what is unknown or of a wrong kind is refused."""
    first, second = tmp_path / "default.toml", tmp_path / "production.toml"
    first.write_text("[search]\nk1 = 1.2\nb = 0.5\n[ingest]\nchunk_words = 100\n")
    second.write_text("[search]\nb = 0.6\n[ingest]\nrate = 2\n")
    config = VaultConfig.load(str(first), str(tmp_path / "missing.toml"), str(second), environ={"LODESTONE__INGEST__CHUNK_WORDS": "50", "OTHER": "1"})
    assert (config.k1, config.b, config.filter_mode) == (1.2, 0.6, "post")
    assert (config.ingest.chunk_words, config.ingest.overlap_words, config.ingest.rate, config.ingest.dim) == (50, 64, 2.0, 1536)
    assert VaultConfig.load(environ={}) == VaultConfig()
    for bad in ({"LODESTONE__SEARCH__X": "1"}, {"LODESTONE__NOWHERE__K1": "1"}, {"LODESTONE__SEARCH__K1": "much"}):
        with pytest.raises(InvalidInputError):
            VaultConfig.load(environ=bad)


def test_ingest_joins_nothing_and_two_files_of_one_id_stay_two(spark):
    rows = [("a", "a.txt", b"one two three", "hybrid_file", "{}", None), ("a", "a.txt", b"four five", "hybrid_file", "{}", None), ("b", "b.txt", b"six", "text_only", "{}", None)]
    files = spark.createDataFrame(rows, "file_id string, filename string, content binary, storage_mode string, metadata string, parent_id string")
    records, payloads = ingest(files, IngestConfig(dim=2))
    assert "Join" not in records._jdf.queryExecution().optimizedPlan().toString() + payloads._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.original_size, r.compressed_size > 0) for r in records.collect()) == [(3, False), (9, True), (13, True)]
    assert payloads.count() == 2


def test_files_are_packed_in_batches_of_bounded_bytes(spark, monkeypatch):
    from lodestone.plans import ingest as module

    @F.pandas_udf("binary")
    def handed(data, kind, level):
        return data.map(lambda _: str(sum(map(len, data))).encode())

    monkeypatch.setattr(module, "compress", handed)
    files = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("file_id"), F.lit("a.txt").alias("filename"), F.repeat(F.lit("a "), 50_000).cast("binary").alias("content"), F.lit("full_raw").alias("storage_mode"), F.lit("{}").alias("metadata"), F.lit(None).cast("string").alias("parent_id"))
    sizes = [int(bytes(r.payload)) for r in module.ingest(files)[1].select("payload").collect()]
    assert len(sizes) == 400 and max(sizes) <= module.BATCH_BYTES + 100_000
