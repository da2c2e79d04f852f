"""Text out of file contents, by modality. Plain texts stay in the JVM; formats and providers are plug-ins."""

from __future__ import annotations

import io
import shutil
import subprocess
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.detect import extension
from ..functions.text import collapse, strip_tags
from ..schema import IngestError, ProviderError

#: What stands for a text that can't be had.
NO_OCR = "[Image: OCR not available — install tesseract]"
NO_TEXT = "[Image: no readable text detected]"
#: Bytes below which recognized text counts as none.
LEAST_OCR_BYTES = 20
#: Extensions whose videos are taken apart; others that count as video are shown as one image.
FRAMED = ("mp4", "mkv", "avi", "mov", "webm")


class Describe(Protocol):
    """A model that turns bytes into text: an image captioner or a transcriber."""

    def __call__(self, content: bytes, filename: str) -> str: ...


@dataclass(frozen=True)
class Providers:
    """What is plugged in for media; None means not available."""

    ocr: Describe | None = None
    caption: Describe | None = None
    transcribe: Describe | None = None
    frames: Callable[[bytes, str], list[bytes]] | None = None
    attempts: int = 3
    pause: float = 0.5
    options: dict = field(default_factory=dict)


def with_retry(call: Callable[[], str], attempts: int = 3, pause: float = 0.5, fatal: tuple[type[Exception], ...] = ()) -> str:
    """Tries again after ``pause`` * 2^i seconds; errors in ``fatal`` are not tried again."""
    last: Exception | None = None
    for i in range(attempts):
        try:
            return call()
        except fatal:
            raise
        except Exception as e:
            last = e
            if i + 1 < attempts:
                time.sleep(pause * 2**i)
    raise ProviderError(last)


def plain_text(content: Column) -> Column:
    """UTF-8 with replacement characters for what is none."""
    return F.make_valid_utf8(content.cast("string"))


def tidy_ocr(text: Column) -> Column:
    """Null (no recognizer) and too short texts have placeholders."""
    clean = collapse(text)
    return F.when(text.isNull(), NO_OCR).when(F.octet_length(clean) < LEAST_OCR_BYTES, NO_TEXT).otherwise(clean)


def image_text(ocr: Column, caption: Column) -> Column:
    return F.trim(F.concat(F.coalesce(ocr, F.lit("")), F.lit(" "), F.coalesce(caption, F.lit(""))))


def video_text(captions: Column, transcript: Column) -> Column:
    """Captions joined by bars; with a transcript, both are marked."""
    seen = F.array_join(captions, " | ")
    return F.when(F.coalesce(transcript, F.lit("")) == "", seen).otherwise(F.concat(F.lit("[Visual]: "), seen, F.lit(" [Audio]: "), transcript))


def docx_markup(content: bytes) -> str | None:
    """The XML of the body; None without one, an error if this is no archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return archive.read("word/document.xml").decode("utf-8", "replace") if "word/document.xml" in archive.namelist() else None
    except zipfile.BadZipFile as e:
        raise IngestError(f"DOCX: {e}") from e


def pdf_text(content: bytes, tool: str = "pdftotext") -> str | None:
    """By a local tool; None if that is missing or fails."""
    if not shutil.which(tool):
        return None
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(content)
        f.flush()
        done = subprocess.run([tool, f.name, "-"], capture_output=True, check=False)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


@F.pandas_udf(T.StringType())
def _docx(content: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else docx_markup(c) for c in content], dtype=object)


@F.pandas_udf(T.StringType())
def _pdf(content: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else pdf_text(c) for c in content], dtype=object)


def document_text(content: Column, filename: Column) -> Column:
    """PDF and DOCX by their formats, all else (and what they can't give) as plain text."""
    ext = extension(filename)
    read = F.when(ext == "pdf", _pdf(F.when(ext == "pdf", content))).when(ext == "docx", strip_tags(_docx(F.when(ext == "docx", content))))
    return F.coalesce(read, plain_text(content))


def _media_task(providers: Providers):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = lambda f, *a: None if f is None else with_retry(lambda: f(*a), providers.attempts, providers.pause)

        def attempt(f, *a):
            try:
                return call(f, *a)
            except ProviderError:
                return None

        for pdf in batches:
            ocr, caption, captions, transcript = [], [], [], []
            for content, name, modality in zip(pdf["content"], pdf["filename"], pdf["modality"], strict=True):
                name = name or ""
                framed = modality == "video" and name.rpartition(".")[2].lower() in FRAMED
                ocr.append(attempt(providers.ocr, content, name) if modality == "image" else None)
                caption.append(attempt(providers.caption, content, name) if modality == "image" or (modality == "video" and not framed) else None)
                shots = (providers.frames(content, name) if providers.frames else []) if framed else []
                captions.append([c for c in (attempt(providers.caption, s, name) for s in shots) if c is not None])
                transcript.append(attempt(providers.transcribe, content, name) if modality == "audio" or framed else None)
            yield pdf.drop(columns=["content"]).assign(ocr=ocr, caption=caption, captions=captions, transcript=transcript)

    return read


def extract_text(files: DataFrame, providers: Providers | None = None) -> DataFrame:
    """``files`` (file_id, filename, modality, content, ...) with a column ``text``.

    Media go through the providers in one pass over Arrow batches; where there are
    none, images get the placeholder and audio and video empty texts.
    """
    plain = files.where(F.col("modality").isin("text", "document")).withColumn(
        "text", F.when(F.col("modality") == "document", document_text(F.col("content"), F.col("filename"))).otherwise(plain_text(F.col("content")))
    )
    media = files.where(F.col("modality").isin("image", "audio", "video"))
    seen = media.select("file_id", "filename", "modality", "content").mapInPandas(
        _media_task(providers or Providers()), f"file_id {files.schema['file_id'].dataType.simpleString()}, filename string, modality string, ocr string, caption string, captions array<string>, transcript string"
    )
    text = (
        F.when(F.col("modality") == "image", image_text(tidy_ocr(F.col("ocr")), F.col("caption")))
        .when(F.col("modality") == "audio", F.coalesce("transcript", F.lit("")))
        .otherwise(F.when(F.col("caption").isNotNull(), F.col("caption")).otherwise(video_text(F.col("captions"), F.col("transcript"))))
    )
    texts = seen.select("file_id", text.alias("text"))
    return plain.unionByName(media.join(texts, "file_id"))
