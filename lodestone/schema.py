"""Record schema, value domains and errors of the retrieval vault."""

from __future__ import annotations

from pyspark.sql import types as T

MODALITIES = ("text", "image", "audio", "video", "document")
STORAGE_MODES = ("text_only", "hybrid_file", "full_raw")
CODECS = ("lzma", "lz4", "zstd")

CODEC = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("level", T.IntegerType())])

#: One row per chunk of an ingested file.
RECORD = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("parent_id", T.StringType()),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("total_chunks", T.IntegerType(), False),
        T.StructField("modality", T.StringType(), False),
        T.StructField("storage_mode", T.StringType(), False),
        T.StructField("codec", CODEC, False),
        T.StructField("filename", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("summary", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
        T.StructField("compressed_embed", T.BinaryType()),
        T.StructField("embedding_dim", T.IntegerType(), False),
        T.StructField("bm25_tokens", T.ArrayType(T.StringType(), False), False),
        T.StructField("metadata", T.StringType(), False),
        T.StructField("original_size", T.LongType(), False),
        T.StructField("compressed_size", T.LongType(), False),
        T.StructField("compression_ratio", T.FloatType(), False),
        T.StructField("created_at", T.LongType(), False),
        T.StructField("updated_at", T.LongType(), False),
        T.StructField("checksum", T.BinaryType(), False),
    ]
)

#: Compressed bytes, kept apart from the records so that search never reads them; one row per parent or single record.
PAYLOAD = T.StructType([T.StructField("payload_id", T.StringType(), False), T.StructField("payload", T.BinaryType(), False)])


class VaultError(Exception):
    """Base of all errors; ``prefix`` begins the message."""

    prefix = "Error"

    def __init__(self, detail: object) -> None:
        super().__init__(f"{self.prefix}: {detail}")


class CompressionError(VaultError):
    prefix = "Compression error"


class StorageError(VaultError):
    prefix = "Storage error"


class IndexingError(VaultError):
    prefix = "Index error"


class IngestError(VaultError):
    prefix = "Ingest error"


class NotFoundError(VaultError):
    prefix = "Record not found"


class InvalidInputError(VaultError):
    prefix = "Invalid input"


class ProviderError(VaultError):
    prefix = "Provider error"


class VaultIOError(VaultError):
    prefix = "I/O error"


class SerdeError(VaultError):
    prefix = "Serde error"


def _member(value: str, domain: tuple[str, ...], what: str) -> str:
    if value.lower() not in domain:
        raise InvalidInputError(f"Unknown {what}: {value}")
    return value.lower()


def parse_modality(value: str) -> str:
    """The modality, whatever the case of its letters."""
    return _member(value, MODALITIES, "modality")


def parse_storage_mode(value: str) -> str:
    return _member(value, STORAGE_MODES, "storage mode")


def format_codec(kind: str, level: int | None) -> str:
    """``lzma(6)``, ``lz4``, ``zstd(3)``."""
    return kind if kind == "lz4" else f"{kind}({level})"
