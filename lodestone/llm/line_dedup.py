"""Line dedup as keep bitmaps, with DataFrame functions only.

Lines are reduced to 128 bits of hash with document and position, and range
partitioned by (hash, document), with position as a secondary sort inside.
The range bounds run over the document too, so a line that a third of all
documents hold is spread over many partitions. A window streams over the sorted
partitions as they are and numbers the occurrences of a line in a document; the first ones
count the documents that hold it. What a partition knows of a hash (documents, largest
document) is one row, so the totals move one row for each hash and partition. Only the
positions of dropped lines go back to their documents, as run lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import unused, written

#: ASCII letters, for a lower-casing that leaves all other characters alone.
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: `[\x20\x09-\x0D]`
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; the fast path is for texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _SMALL))


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, pos) of the lines that go.

    A key of ``min_chars`` code points or more that stands in ``min_docs``
    documents or more loses its lines except in the largest doc_id that holds
    it (all of them there). Rows of one doc_id are one document; a null doc_id
    counts as a document below all others.
    """
    # letters and blanks are dealt with before the explode, so that each is looked at once
    trimmed = F.transform(lines_of(ascii_lower(F.col("text"))), lambda line: F.btrim(line, F.lit(BLANKS)))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.posexplode(trimmed).alias("pos", "key"))
    lines = lines.where(F.char_length("key") >= min_chars)
    # written: the range bounds and both readers below would each go through the texts again
    keyed = written(lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos"), "line-hashes")
    ranged = keyed.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    # the range partitioning keeps a (hash, document) together and in order, so this needs neither an exchange nor a sort
    occurrence = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos"))
    first = ranged.withColumn("occurrence", occurrence).where("occurrence = 1")
    wide = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs).drop("n")
    # a table of its own: the join then has an exchange on either side, and a hot line can be split
    wide = written(wide, "repeated-lines")
    gone = keyed.join(wide.withColumnsRenamed({"h1": "g1", "h2": "g2"}), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return gone.select("doc_id", "text_hash", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per document that loses lines: doc_id, text_hash, n_dropped, keep_runs.

    ``keep_runs`` is the keep bitmap over the document's lines, compressed: the
    lengths of runs of kept and dropped lines in turn, kept first (it may be 0),
    without the last kept run, as 4-byte big-endian integers.
    """
    gone = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    p = F.col("p")
    starts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
    ends = F.transform(F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True))), lambda x: x + 1)
    gone = gone.select("doc_id", "text_hash", F.size("p").cast("long").alias("n_dropped"), starts.alias("s"), ends.alias("e"))
    runs = F.flatten(F.transform("s", lambda s, i: F.array(s - F.when(i == 0, 0).otherwise(F.get(F.col("e"), i - 1)), F.get(F.col("e"), i) - s)))
    return gone.select("doc_id", "text_hash", "n_dropped", F.unhex(F.array_join(F.transform(runs, lambda r: F.lpad(F.hex(r), 8, "0")), "")).alias("keep_runs"))


def apply_bitmap(lines: Column, keep_runs: Column) -> Column:
    """The kept lines joined by newlines; a null bitmap keeps all."""
    runs = F.transform(
        F.sequence(F.lit(0), (F.octet_length(keep_runs) / 4).cast("int") - 1),
        lambda i: F.conv(F.hex(F.substring(keep_runs, i * 4 + 1, F.lit(4))), 16, 10).cast("int"),
    )
    # a kept line has the bit of its run: runs become one array of flags, as long as the lines
    flags = F.flatten(F.transform(runs, lambda r, i: F.array_repeat(i % 2 == 0, r)))
    kept = F.filter(lines, lambda _, i: F.coalesce(F.get(flags, i), F.lit(True)))
    return F.when(keep_runs.isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with repeated lines cut out of ``text``, all columns and rows kept.

    Null and empty texts are one empty line and become empty texts; a document
    all of whose lines go has an empty text. Repeated rows are cut alike. Two
    columns are added, n_lines (before) and n_dropped; where the input has such
    columns they are replaced.
    """
    key_name, map_name = unused(docs, "__key"), unused(docs, "__map")
    maps = keep_bitmaps(docs, min_chars, min_docs).select(F.struct("doc_id", "text_hash").alias("__doc_of_map"), F.struct("n_dropped", "keep_runs").alias(map_name))
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    other = unused(docs, "__doc")
    # the bitmaps are the small side: a hash join spares the sort of the texts
    joined = docs.withColumn(key_name, key).join(maps.hint("shuffle_hash").withColumnRenamed("__doc_of_map", other), F.col(key_name).eqNullSafe(F.col(other)), "left").drop(key_name, other)
    lines, found = lines_of(F.col("text")), F.col(map_name)
    return joined.withColumns(
        {
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.coalesce(found["n_dropped"], F.lit(0)).cast("long"),
            "text": F.when(found.isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(apply_bitmap(lines, found["keep_runs"])),
        }
    ).drop(map_name)
