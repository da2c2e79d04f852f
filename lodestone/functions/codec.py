"""Codecs for payloads and embeddings. Codecs themselves are Arrow-batched functions: Spark has none on columns."""

from __future__ import annotations

import lzma
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CODECS, CompressionError

#: Codec and level by modality.
BY_MODALITY = {"text": ("lzma", 6), "document": ("lzma", 6), "audio": ("lzma", 4), "image": ("zstd", 9), "video": ("lz4", None)}
EMBEDDING_LEVEL = 3


def select_codec(modality: Column) -> Column:
    """STRUCT<kind, level> for a modality."""
    as_struct = lambda kind, level: F.struct(F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"))
    table = F.create_map(*[x for name, codec in BY_MODALITY.items() for x in (F.lit(name), as_struct(*codec))])
    return F.coalesce(F.try_element_at(table, modality), as_struct("lzma", 6))


def format_codec(codec: Column) -> Column:
    return F.when(codec["kind"] == "lz4", "lz4").otherwise(F.concat(codec["kind"], F.lit("("), codec["level"].cast("string"), F.lit(")")))


def compress_bytes(data: bytes, kind: str, level: int | None = None) -> bytes:
    """``lzma`` is an .xz container with CRC64, ``lz4`` a raw block without its size, ``zstd`` one frame."""
    if kind == "lzma":
        return lzma.compress(data, format=lzma.FORMAT_XZ, check=lzma.CHECK_CRC64, preset=6 if level is None else int(level))
    if kind == "lz4":
        return pa.Codec("lz4_raw").compress(data, asbytes=True)
    if kind == "zstd":
        return zstandard.ZstdCompressor(level=3 if level is None else int(level)).compress(data)
    raise CompressionError(f"unknown codec {kind}, not one of {CODECS}")


def decompress_bytes(data: bytes, kind: str, size: int) -> bytes:
    """The bytes back; ``size`` is that of the original, as the record has it."""
    try:
        if kind == "lzma":
            return lzma.decompress(data, format=lzma.FORMAT_XZ)
        if kind == "lz4":
            return pa.Codec("lz4_raw").decompress(data, int(size), asbytes=True) if size else b""
        if kind == "zstd":
            return zstandard.ZstdDecompressor().decompress(data, max_output_size=max(int(size), 1))
    except CompressionError:
        raise
    except Exception as e:
        raise CompressionError(f"{kind} decompress: {e}") from e
    raise CompressionError(f"unknown codec {kind}, not one of {CODECS}")


@F.pandas_udf(T.BinaryType())
def compress(data: pd.Series, kind: pd.Series, level: pd.Series) -> pd.Series:
    """``compress_bytes`` of a column; null stays null."""
    return pd.Series([None if d is None else compress_bytes(d, k, None if n is None or math.isnan(n) else int(n)) for d, k, n in zip(data, kind, level, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def decompress(data: pd.Series, kind: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else decompress_bytes(d, k, n) for d, k, n in zip(data, kind, size, strict=True)], dtype=object)


def delta_encode(vector: Column) -> Column:
    """First value, then differences, in FLOAT."""
    before = F.slice(F.concat(F.array(F.lit(0.0).cast("float")), vector), F.lit(1), F.size(vector))
    return F.zip_with(vector, before, lambda x, y: (x - y).cast("float"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def delta_decode(deltas: pd.Series) -> pd.Series:
    """Running sums, in FLOAT: equal to the input up to rounding."""
    return pd.Series([None if d is None else np.cumsum(np.asarray(d, np.float32), dtype=np.float32) for d in deltas], dtype=object)


def embedding_to_bytes(vector: np.ndarray) -> bytes:
    """Deltas as little-endian floats, zstd(3)."""
    v = np.asarray(vector, "<f4")
    return zstandard.ZstdCompressor(level=EMBEDDING_LEVEL).compress(np.diff(v, prepend=np.float32(0)).astype("<f4").tobytes())


def embedding_from_bytes(data: bytes, dim: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(dim * 4, 1))
    if len(raw) != dim * 4:
        raise CompressionError(f"embedding has {len(raw) // 4} values, not {dim}")
    return np.cumsum(np.frombuffer(raw, "<f4"), dtype=np.float32)


@F.pandas_udf(T.BinaryType())
def compress_embedding(vector: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else embedding_to_bytes(v) for v in vector], dtype=object)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decompress_embedding(data: pd.Series, dim: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else embedding_from_bytes(d, int(n)) for d, n in zip(data, dim, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def floats_to_bytes(vector: pd.Series) -> pd.Series:
    """Little-endian floats, as vectors travel on the wire."""
    return pd.Series([None if v is None else np.asarray(v, "<f4").tobytes() for v in vector], dtype=object)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def floats_from_bytes(data: pd.Series) -> pd.Series:
    """Null where the length is no multiple of 4."""
    return pd.Series([None if d is None or len(d) % 4 else np.frombuffer(d, "<f4") for d in data], dtype=object)


def checksum(content: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(content, 256))
