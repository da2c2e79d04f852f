"""Tokens, tags, detection, chunks, metadata and codecs on literal cases and against small models."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import chunk, codec, detect, metadata, text
from lodestone.schema import CompressionError, InvalidInputError, NotFoundError, format_codec, parse_modality, parse_storage_mode


def each(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def test_tokenize(spark):
    cases = ["Data-driven optimization!", "This is a test of the system", "a ab abc abcd", "ab_cd été", "", "x x", "Test test TEST"]
    assert each(spark, cases, text.tokenize) == [["data", "driven", "optimization"], ["test", "system"], ["abc", "abcd"], ["été"], [], [], ["test"]]
    assert each(spark, ["é", "This is a test", "a"], text.tokenize_query) == [["é"], ["this", "is", "test"], []]


def test_words_and_tags(spark):
    assert each(spark, ["a b\tc ", "", "  "], text.word_count) == [3, 0, 0]
    assert each(spark, ["<p>a > b</p>\n c &amp; d <br", "x<y", "<a>1</a><b>2</b>"], text.strip_tags) == ["a b c &amp; d", "x", "12"]
    assert each(spark, ["a" * 18, "a" * 19], text.preview_filename) == ["a" * 18, "a" * 16 + ".."]
    assert each(spark, ["a\nb", "b" * 51], text.preview_summary) == ["a b", "b" * 47 + "..."]


def test_extensions(spark):
    cases = ["a.TXT", ".txt", "a.tar.gz", "dir.d/file", "foo.", "a.txt/", "..", "..txt", ""]
    assert each(spark, cases, detect.extension) == ["txt", "", "gz", "", "", "txt", "", "txt", ""]


def test_modality(spark):
    rows = [("x.ts", None), ("doc.txt", b"%PDF-1"), ("file.unknown", b"%PDF-1"), ("f", b"\xff\xd8\xff0"), ("f", b"\x89PNG\r\n\x1a\n"), ("f", b"0000ftypmp4"), ("f", b"RIFF0000WAVE"), ("f", b"OggS"), ("f", b"GIF89a"), ("f", b"RIFF0000W"), ("", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, c binary")
    got = [r.m for r in df.select("i", detect.detect_modality(F.col("f"), F.col("c")).alias("m")).orderBy("i").collect()]
    assert got == ["video", "text", "document", "image", "image", "video", "audio", "audio", "image", "text", "text"]
    assert each(spark, ["a.pdf", "a.TIFF", "a.toml", "a"], detect.detect_mime_type) == ["application/pdf", "image/tiff", detect.OCTET_STREAM, detect.OCTET_STREAM]


def model_chunks(value, n, overlap):
    """Sentence packing, step by step."""
    if len(value.split()) <= n:
        return [value]
    parts = [s.strip() for s in re.findall(r"[^.?!]*[.?!]|[^.?!]+$", value)]
    out, acc, held = [], [], 0
    for s in [p for p in parts if p]:
        size = len(s.split())
        if held + size > n and acc:
            out.append(" ".join(acc))
            last = " ".join(acc).split()
            last = last[max(0, len(last) - overlap) :] if overlap else []
            acc, held = [" ".join(last)], len(last)
        acc.append(s)
        held += size
    return [*out, " ".join(acc)] if acc else out or [value]


@pytest.mark.parametrize(("n", "overlap"), [(20, 5), (10, 3), (4, 0), (3, 10)])
def test_chunks(spark, n, overlap):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone."
    cases = ["The quick brown fox jumps over the lazy dog. " * 20, "Pi is 3.14 and so on... is it? Yes! " * 9, long + " short. " + long, "", "few words", "no end " * 40, "... ... ... ... ..."]
    assert each(spark, cases, lambda v: chunk.chunk_text(v, n, overlap)) == [model_chunks(c, n, overlap) for c in cases]
    assert each(spark, ["a b c", "a b c d"], lambda v: chunk.should_chunk(v, 3)) == [False, True]


def test_metadata(spark):
    cases = ['{"k":"x"}', '{"k":"1"}', '{"k":1}', '{"k":true}', '{"k":null}', '{"k":["x"]}', '{"j":"x"}', "no json", '{"a.b":"x"}', None]
    assert each(spark, cases, lambda v: metadata.matches(v, "k", "1")) == [False, True] + [False] * 8
    assert each(spark, cases, lambda v: metadata.string_value(v, "a.b"))[8] == "x"
    assert metadata.candidate(F.col("m"), F.col("j"), None, {"n": 3}) is None
    df = spark.createDataFrame([("text", '{"k":"x"}'), ("image", '{"k":"x"}'), ("text", "{}")], "m string, j string")
    assert df.where(metadata.candidate(F.col("m"), F.col("j"), "text", '{"k": "x", "n": 3}')).count() == 1


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([("lzma", 6), ("lz4", None), ("zstd", 3)]))
def test_codecs_give_bytes_back(data, how):
    packed = codec.compress_bytes(data, *how)
    assert codec.decompress_bytes(packed, how[0], len(data)) == data


def test_codec_errors():
    zeros = bytes(1_000_000)
    for how in (("lzma", 6), ("lz4", None), ("zstd", 9)):
        packed = codec.compress_bytes(zeros, *how)
        assert len(packed) < 10_000 and codec.decompress_bytes(packed, how[0], len(zeros)) == zeros
    with pytest.raises(CompressionError, match="Compression error"):
        codec.decompress_bytes(codec.compress_bytes(b"abcdefgh" * 9, "lz4"), "lz4", 5)
    with pytest.raises(CompressionError):
        codec.decompress_bytes(b"junk", "lzma", 10)
    with pytest.raises(CompressionError):
        codec.compress_bytes(b"", "brotli")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1, 1, width=32), min_size=1, max_size=64))
def test_embeddings_come_back(values):
    back = codec.embedding_from_bytes(codec.embedding_to_bytes(np.array(values, np.float32)), len(values))
    assert np.abs(back - np.array(values, np.float32)).max() < 1e-5
    with pytest.raises(CompressionError):
        codec.embedding_from_bytes(codec.embedding_to_bytes(np.zeros(8)), 4)


def test_codec_columns(spark):
    df = spark.createDataFrame([("text", b"abc" * 50), ("image", b""), ("video", b"xyz" * 9), ("audio", None)], "m string, d binary")
    packed = df.select("m", "d", codec.select_codec(F.col("m")).alias("c")).withColumn("p", codec.compress("d", "c.kind", "c.level"))
    back = packed.select("m", codec.format_codec(F.col("c")).alias("c"), "d", codec.decompress("p", "c.kind", F.octet_length("d")).alias("b")).collect()
    assert {r.m: r.c for r in back} == {"text": "lzma(6)", "image": "zstd(9)", "video": "lz4", "audio": "lzma(4)"}
    assert all(r.b == r.d for r in back)
    one = spark.createDataFrame([([0.5, 0.25, -1.0],), ([],)], "v array<float>")
    assert [r.d for r in one.select(codec.delta_encode(F.col("v")).alias("d")).collect()] == [[0.5, -0.25, -1.25], []]
    assert [r.d for r in one.select(codec.delta_decode(codec.delta_encode(F.col("v"))).alias("d")).collect()] == [[0.5, 0.25, -1.0], []]


def test_names():
    assert parse_modality("TEXT") == "text" and parse_storage_mode("Full_Raw") == "full_raw"
    with pytest.raises(InvalidInputError, match="Invalid input: Unknown modality: smell"):
        parse_modality("smell")
    assert [format_codec("lzma", 6), format_codec("lz4", None)] == ["lzma(6)", "lz4"]
    assert str(NotFoundError("x")) == "Record not found: x"


def test_tokens_end_at_marks_that_are_no_letters(spark):
    """A combining accent is no letter and splits a word; a vowel sign of Hindi counts as one and does not."""
    df = spark.createDataFrame([("cafébar हिन्दी x²yz",)], "t string")
    assert [sorted(r.w) for r in df.select(text.tokenize(F.col("t")).alias("w")).collect()] == [sorted(["cafe", "bar", "हिन", "दी", "x²yz"])]
