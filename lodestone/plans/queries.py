"""One query per operator, over the test tables: documents are records, embeddings their vectors, benchmark items queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunk, codec, detect, metadata, text
from ..operators import bm25, hybrid, vector
from ..sources.extract import image_text, tidy_ocr, video_text
from ..sources.shared import folder, n_parts, stored_bytes, written
from ..sources.store import frames
from . import vault
from .ingest import IngestConfig, ingest, validate

Query = Callable[[SparkSession, str], DataFrame]

#: The single query of the examples, its vector (by vec_id), hits asked for, and the sizes of chunks.
QUERY_TEXT, QUERY_VECTOR, K = "the reandhe of tion and ererent", 0, 10
CHUNK, OVERLAP = 128, 16
#: Extensions that file names are given in turn, by doc_id.
NAMES = ("txt", "pdf", "png", "mp3", "mp4", "md", "docx", "", "ts", "rst")
FRAME = 4096
#: Bytes of stored token lists whose postings one task sorts: 100,000 postings have about half a megabyte.
INDEX_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filename() -> Column:
    """A name for each document: d<doc_id> with the extension that its id picks."""
    ext = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    return F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: id, text, tokens, modality, metadata."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("summary"),
        filename().alias("filename"),
        detect.detect_modality(filename()).alias("modality"),
        F.to_json(F.struct("lang", "source")).alias("metadata"),
        F.lit(None).cast("long").alias("parent_id"),
    )


#: Folders of the indexes that this process has built, by application, and the files they were built from.
_INDEXES: dict[tuple, str] = {}


def files_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: another set of them is another table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in listed))


def indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings and statistics of the documents: an index is built once for a session and a state of the table, and read by every search."""
    name = (spark.sparkContext.applicationId, files_of(spark, f"{sf_dir}/documents.parquet"))
    if name not in _INDEXES:
        path = f"{folder(spark)}/index-{uuid.uuid4().hex}"
        tokens = written(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.tokenize(F.col("text")).alias("bm25_tokens")), "tokens")
        bm25.sorted_postings(tokens, n_parts(stored_bytes(tokens), each=INDEX_BYTES)).write.option("compression", "zstd").parquet(f"{path}/postings")
        bm25.corpus_stats(tokens).coalesce(1).write.parquet(f"{path}/stats")
        _INDEXES[name] = path
    return spark.read.parquet(f"{_INDEXES[name]}/postings"), spark.read.parquet(f"{_INDEXES[name]}/stats")


def one_query(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("qid"), F.explode(text.tokenize_query(F.lit(QUERY_TEXT))).alias("token"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str, zero: bool = False) -> DataFrame:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_VECTOR)
    value = F.transform("embedding", lambda x: x * 0) if zero else F.col("embedding")
    return row.select(F.lit(0).alias("qid"), value.alias("embedding"))


# --- text ---------------------------------------------------------------------------------------------------------


def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.tokenize(F.col("text"))).alias("token"))


def tokenize_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.tokenize_query(F.col("text"))).alias("token"))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.terms(F.col("text"))).alias("token"))
    return flat.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("n_words"))


def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("stripped"))


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("a-rather-long-"), filename())
    return table(spark, sf_dir, "documents").select("doc_id", text.preview_filename(name).alias("filename"), text.preview_summary(F.col("text")).alias("summary"))


# --- index and search ---------------------------------------------------------------------------------------------


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_docs(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokenize(F.col("text"))).cast("long").alias("doc_len"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir)[1].select("n", F.round("avg_len", 6).alias("avg_len"))


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.scores(*indexed(spark, sf_dir), one_query(spark)).select(F.col("id").alias("doc_id"), "score")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.top(bm25.scores(*indexed(spark, sf_dir), one_query(spark)), K).select(F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def bm25_tf_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with repetitions: term frequencies above 1."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.terms(F.col("text")).alias("bm25_tokens"))
    scored = bm25.scores(bm25.postings(docs), bm25.corpus_stats(docs), one_query(spark), k1=1.2)
    return scored.select(F.col("id").alias("doc_id"), "score")


def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.broadcast(query_vector(spark, sf_dir).select(F.col("embedding").alias("q")))
    return vectors(spark, sf_dir).join(q).select(F.col("id").alias("vec_id"), F.round(vector.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


def _vector_hits(spark: SparkSession, sf_dir: str, zero: bool) -> DataFrame:
    found = vector.search(vectors(spark, sf_dir), query_vector(spark, sf_dir, zero), K)
    return found.select(F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_hits(spark, sf_dir, False)


def cosine_zero_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_hits(spark, sf_dir, True)


def vector_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of one in fifty, against all."""
    queries = vectors(spark, sf_dir).where(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), "embedding")
    return vector.search(vectors(spark, sf_dir), queries, K).select("qid", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def _hits(spark: SparkSession, sf_dir: str, weight: float = 0.5, modality: str | None = None, filters: dict | None = None, mode: str = "post") -> DataFrame:
    """Single-query hybrid search. Embeddings hold vectors for some of the documents, and for ids that are none."""
    keep = metadata.candidate(F.col("modality"), F.col("metadata"), modality, filters)
    docs, vecs = table(spark, sf_dir, "documents"), vectors(spark, sf_dir)
    named = records(spark, sf_dir)
    wanted = named.where(keep).select("id") if keep is not None else None
    if mode == "pre" and wanted is not None:
        # statistics are those of what is left, so there is no index to read
        tokens = docs.select(F.col("doc_id").alias("id"), text.tokenize(F.col("text")).alias("bm25_tokens")).join(wanted, "id", "left_semi")
        index, vecs, wanted = (bm25.postings(tokens), bm25.corpus_stats(tokens)), vecs.join(wanted, "id", "left_semi"), None
    else:
        index = indexed(spark, sf_dir)
    text_arm = bm25.top(bm25.scores(*index, one_query(spark)), K * hybrid.OVER_FETCH)
    vector_arm = vector.search(vecs, query_vector(spark, sf_dir), K * hybrid.OVER_FETCH)
    return hybrid.hybrid(vector_arm, text_arm, K, weight, wanted)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_hits(spark, sf_dir))


def hybrid_pure_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_hits(spark, sf_dir, 0.0))


def hybrid_pure_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_hits(spark, sf_dir, 1.0))


def hybrid_modality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_hits(spark, sf_dir, modality="text"))


def hybrid_metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_hits(spark, sf_dir, filters={"lang": "en", "n": 3}))


def hybrid_filter_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_hits(spark, sf_dir, modality="text", filters={"lang": "en"}))


def hybrid_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_hits(spark, sf_dir, modality="text", filters={"lang": "en"}, mode="pre"))


def hybrid_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with names, modality, metadata and whether a payload is there (every third document has one)."""
    payloads = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("payload_id"))
    shown = hybrid.enrich(_hits(spark, sf_dir), records(spark, sf_dir), payloads)
    return shown.select(F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"), "filename", "modality", metadata.string_value(F.col("metadata"), "lang").alias("lang"), "has_payload")


def hybrid_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query, with the vector of the same id."""
    items = table(spark, sf_dir, "benchmark")
    tokens = items.select(F.col("item_id").alias("qid"), F.explode(text.tokenize_query(F.col("text"))).alias("token"))
    text_arm = bm25.top(bm25.scores(*indexed(spark, sf_dir), tokens), K * hybrid.OVER_FETCH)
    queries = items.join(vectors(spark, sf_dir), F.col("item_id") == F.col("id")).select(F.col("item_id").alias("qid"), "embedding")
    vector_arm = vector.search(vectors(spark, sf_dir), queries, K * hybrid.OVER_FETCH)
    return hybrid.hybrid(vector_arm, text_arm, K).select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


# --- metadata and detection ---------------------------------------------------------------------------------------


def metadata_kv_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where(metadata.matches(F.col("metadata"), "source", "src3")).select(F.col("id").alias("doc_id"))


def metadata_nonstring_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of k are numbers: none equals the string."""
    return table(spark, sf_dir, "events").where(metadata.matches(F.col("props"), "k", "1")).select("event_id")


def detect_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(b"%PDF-"), F.col("text").cast("binary"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(b"GIF89a"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", filename().alias("filename"), detect.detect_modality(filename(), content).alias("modality"))


def detect_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", detect.detect_mime_type(filename()).alias("mime_type"))


# --- chunks and records -------------------------------------------------------------------------------------------


def should_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", chunk.should_chunk(F.col("text"), CHUNK).alias("chunked"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.chunk_text(F.col("text"), CHUNK, OVERLAP)).alias("chunk_index", "chunk"))
    return split.withColumn("chunk_index", F.col("chunk_index").cast("long"))


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_text(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_chunks"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files, one in two kept with its bytes."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("file_id"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("text").cast("binary").alias("content"),
        F.when(F.col("doc_id") % 2 == 0, "hybrid_file").otherwise("text_only").alias("storage_mode"),
        F.to_json(F.struct("lang", "source")).alias("metadata"),
        F.lit(None).cast("string").alias("parent_id"),
    )


def ingest_local_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = ingest(files(spark, sf_dir), IngestConfig(chunk_words=CHUNK, overlap_words=OVERLAP, dim=8))
    return made.select(
        F.regexp_extract("filename", r"(\d+)", 1).cast("long").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), "modality", "storage_mode",
        codec.format_codec(F.col("codec")).alias("codec"), "mime_type", F.sha2("summary", 256).alias("summary_sha256"), F.size("bm25_tokens").cast("long").alias("n_tokens"), "original_size", F.hex("checksum").alias("checksum"),
    )


def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the response to an ingest adds up; stored bytes depend on the codec's release and are not compared."""
    made, _ = ingest(files(spark, sf_dir), IngestConfig(chunk_words=CHUNK, overlap_words=OVERLAP, dim=8))
    return vault.ingest_totals(made).select("files", "records", "original_bytes")


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of documents, each field of some of them wrong or missing."""
    pick = lambda *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))
    requests = table(spark, sf_dir, "documents").select(
        "doc_id",
        pick("text_only", "HYBRID_FILE", "full_raw", None, "text_only", "raw", "text_only", "full_raw", "text_only").alias("storage_mode"),
        pick("text", "Image", None, "", "document", "film", "audio").alias("modality"),
        pick("{}", "", None, '{"k": 1}', "no json").alias("metadata"),
        pick(None, "", "0f8fad5b-d9cb-469f-a165-70867728950e", "x").alias("parent_id"),
        F.encode(F.repeat(F.lit("a"), F.when(F.col("doc_id") % 11 == 0, 15).when(F.col("doc_id") % 13 == 0, 12).otherwise(16)), "utf-8").alias("embedding_bytes"),
    )
    return validate(requests, 4).select("doc_id", "error")


def vault_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ingested into a vault, French ones deleted: what is left of each file, and what fetching its first record finds."""
    kept = vault.Vault(spark, f"{folder(spark)}/vault-{uuid.uuid4().hex}", vault.VaultConfig(ingest=IngestConfig(chunk_words=CHUNK, overlap_words=OVERLAP, dim=8)))
    kept.ingest(files(spark, sf_dir))
    records = kept.store.records()
    kept.store.delete(records.where(metadata.matches(F.col("metadata"), "lang", "fr")).select("id"))
    asked = written(records.where("chunk_index = 0").select("id", "filename", "parent_id", "original_size"), "asked")
    found = kept.store.exists(asked)
    alive = kept.store.records().groupBy(F.col("filename").alias("f")).agg(F.count(F.lit(1)).alias("records"))
    described = kept.store.search_metadata("lang", "en").withColumn("english", F.lit(True))
    stored = kept.store.fetch(asked).select("id", F.lit(True).alias("fetched")).distinct()
    rows = asked.join(found, "id").join(described, "id", "left").join(stored, "id", "left").join(alive, F.col("filename") == F.col("f"), "left")
    none = F.lit(False)
    return rows.select(F.regexp_extract("filename", r"(\d+)", 1).cast("long").alias("doc_id"), "found", F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce("english", none).alias("english"), F.coalesce("fetched", none).alias("fetched"))


def parent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations put together from their turns."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("parent_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("summary"))
    return vault.parent_rollup(turns).select(F.col("parent_id").alias("conv_id"), "chunks", F.sha2("text", 256).alias("text_sha256"))


# --- store --------------------------------------------------------------------------------------------------------


def fetch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = frames(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("payload")), FRAME)
    return cut.select(F.col("id").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.sha2("data", 256).alias("data_sha256"), "total_bytes")


# --- codecs -------------------------------------------------------------------------------------------------------


def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode(codec.delta_encode(F.col("embedding"))).alias("pos", "delta"))
    return deltas.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round(F.col("delta").cast("double"), 4) + 0.0).alias("delta"))


def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether decoding what was encoded gives the vector, up to the tolerance of floats."""
    back = codec.delta_decode(codec.delta_encode(F.col("embedding")))
    worst = F.array_max(F.zip_with("embedding", back, lambda a, b: F.abs(a - b)))
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), (worst < 1e-5).alias("same"))


def select_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", codec.format_codec(codec.select_codec(detect.detect_modality(filename()))).alias("codec"))


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of documents as they come back from the codec of their modality: size and digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"), codec.select_codec(detect.detect_modality(filename())).alias("c"))
    packed = docs.withColumn("packed", codec.compress("raw", "c.kind", "c.level"))
    back = packed.withColumn("back", codec.decompress("packed", "c.kind", F.octet_length("raw")))
    return back.select("doc_id", F.octet_length("back").cast("long").alias("size"), F.sha2("back", 256).alias("sha256"))


def embedding_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = vectors(spark, sf_dir).select("id", "embedding", codec.compress_embedding("embedding").alias("packed"))
    worst = F.array_max(F.zip_with("embedding", codec.decompress_embedding("packed", F.size("embedding")), lambda a, b: F.abs(a - b)))
    return packed.select(F.col("id").alias("vec_id"), (worst < 1e-5).alias("same"))


def embedding_bytes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of the vectors, as read back from their bytes."""
    back = codec.floats_from_bytes(codec.floats_to_bytes("embedding"))
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode(back).alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


def checksum_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(codec.checksum(F.col("text").cast("binary")))).alias("checksum"))


def media_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How texts of images and videos are put together, with document texts for what models would say."""
    docs = table(spark, sf_dir, "documents")
    seen = F.when(F.col("doc_id") % 3 != 0, F.col("text"))
    shots = chunk.sentences(F.col("text"))
    heard = F.when(F.col("doc_id") % 2 == 0, F.lit("words")).otherwise("")
    return docs.select("doc_id", image_text(tidy_ocr(seen), F.lit("a picture")).alias("image"), video_text(shots, heard).alias("video"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        tokenize_docs, tokenize_query_terms, term_frequency, word_counts, strip_tags, previews, document_frequency, doc_lengths, corpus_stats,
        bm25_scores, bm25_topk, bm25_tf_variant, cosine_scores, cosine_topk, cosine_zero_query, vector_batch, hybrid_rrf, hybrid_pure_bm25,
        hybrid_pure_vector, hybrid_modality_filter, hybrid_metadata_filter, hybrid_filter_intersection, hybrid_prefilter, hybrid_enriched,
        hybrid_batch, metadata_kv_search, metadata_nonstring_no_match, detect_modality, detect_mime, should_chunk, sentences, chunk_text,
        chunk_counts, ingest_local_records, ingest_totals, request_validation, vault_lifecycle, parent_rollup, 
        fetch_frames, delta_encode, delta_decode, select_codec, codec_roundtrip, embedding_codec_roundtrip,
        embedding_bytes_roundtrip, checksum_sha256, media_texts,
    )
}
