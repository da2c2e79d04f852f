"""Modality and MIME type from names and first bytes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by modality.
EXTENSIONS = {
    "text": "txt md json csv xml yaml yml toml rst",
    "document": "pdf docx xlsx pptx odt ods",
    "image": "jpg jpeg png gif webp bmp tiff tif avif",
    "audio": "mp3 wav flac ogg aac opus m4a",
    "video": "mp4 mkv avi mov webm m4v ts",
}
#: MIME types by extension; all others are octet streams.
MIME_TYPES = {
    "text/plain": "txt text",
    "text/markdown": "md",
    "application/json": "json",
    "text/csv": "csv",
    "application/xml": "xml",
    "application/yaml": "yaml yml",
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "image/jpeg": "jpg jpeg",
    "image/png": "png",
    "image/gif": "gif",
    "image/webp": "webp",
    "image/bmp": "bmp",
    "image/tiff": "tiff tif",
    "audio/mpeg": "mp3",
    "audio/wav": "wav",
    "audio/flac": "flac",
    "audio/ogg": "ogg",
    "audio/aac": "aac",
    "audio/opus": "opus",
    "video/mp4": "mp4",
    "video/x-matroska": "mkv",
    "video/x-msvideo": "avi",
    "video/quicktime": "mov",
    "video/webm": "webm",
}
OCTET_STREAM = "application/octet-stream"


def extension(filename: Column) -> Column:
    """Lower-cased, after the last dot of the base name; a leading dot begins none."""
    base = F.regexp_extract(filename, "([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(base, r"^.+\.([^.]*)$", 1))


def _by_extension(ext: Column, table: dict[str, str]) -> Column:
    """Looked up in a constant map, so the extension is worked out once; null where it is not listed."""
    pairs = [F.lit(x) for value, names in table.items() for name in names.split() for x in (name, value)]
    return F.try_element_at(F.create_map(*pairs), ext)


def detect_modality(filename: Column, content: Column | None = None) -> Column:
    """By extension, else by the first bytes, else text."""
    named = _by_extension(extension(filename), EXTENSIONS)
    if content is None:
        return F.coalesce(named, F.lit("text"))
    starts = lambda magic: F.startswith(content, F.lit(magic))
    at = lambda place, magic: F.substring(content, place + 1, len(magic)) == F.lit(magic)
    sniffed = (
        F.when(starts(b"\xff\xd8\xff") | starts(b"\x89PNG\r\n\x1a\n"), "image")
        .when(starts(b"%PDF"), "document")
        .when((F.octet_length(content) > 8) & at(4, b"ftyp"), "video")
        .when(starts(b"RIFF") & at(8, b"WAVE"), "audio")
        .when(starts(b"OggS"), "audio")
        .when(starts(b"GIF87a") | starts(b"GIF89a"), "image")
    )
    return F.coalesce(named, sniffed, F.lit("text"))


def detect_mime_type(filename: Column) -> Column:
    return F.coalesce(_by_extension(extension(filename), MIME_TYPES), F.lit(OCTET_STREAM))
