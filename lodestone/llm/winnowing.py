"""Benchmark decontamination by winnowing.

Every text is cut into lower-cased words. Of the hashes of k consecutive words
the least in each window of w is kept, so any span of k + w - 1 words that a
document shares with a benchmark item leaves at least one kept hash in both.
Kept hashes of documents are joined with those of the benchmark, and each hit
is extended to the windows of ``span_words`` words around it that an item has too;
windows that follow each other are one span. No pairs of places are made, so a
text and an item that repeat one word a thousand times cost no more than others.

The benchmark side is the query set: it is read in blocks of a bounded number
of bytes, each is broadcast to the scan of the documents, and the spans found
for the blocks are put together per document. With one block there is no
shuffle at all. Items of fewer than ``span_words`` words are matched whole, by
the hashes of as many consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts

#: k of the k-grams; the window is chosen so that k + w - 1 = span_words.
GRAM_WORDS = 8
#: Most bytes of benchmark text in one broadcast.
BLOCK_BYTES = 16 << 20
#: A document is contaminated when at least one in so many of its words is hit.
ONE_IN = 20


def _kept(hashes: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes that winnowing keeps; all of equal least ones are kept."""
    grams = ts.gram_hashes(hashes, k)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    ends = np.repeat(first[1:], np.diff(first))[: len(grams)]
    whole = np.arange(len(grams)) + k <= ends
    grams = np.where(whole, grams, np.uint64(2**64 - 1))
    least = grams.copy()
    for o in range(1, min(w, len(grams))):
        np.minimum(least[: len(grams) - o], grams[o:], out=least[: len(grams) - o])
    keep = np.zeros(len(grams), bool)
    for o in range(min(w, len(grams))):
        keep[o:] |= grams[o:] == least[: len(grams) - o]
    at = np.flatnonzero(keep & whole)
    return at, grams[at]


class _Block:
    """The fingerprints and words of a bounded part of the benchmark."""

    def __init__(self, items: list[tuple], span: int, k: int) -> None:
        texts = pa.array([text for _, text in items], pa.string())
        raw, offsets = ts.flat(texts)
        raw = ts.LOWER[raw]
        starts, ends, first = ts.words(raw, offsets, ts.ALNUM_WORD)
        self.ids = [None if i is None else str(i) for i, _ in items]
        self.words = ts.span_hashes(ts.prefix_hashes(raw), starts, ends)
        self.owner, self.first = ts.owners(first), first
        sizes = np.diff(first)
        self.grams = np.unique(_kept(self.words, first, k, span - k + 1)[1])
        # for each number of words in a window: the windows' hashes, sorted, and the item of each
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {span, *sizes[(sizes > 0) & (sizes < span)].tolist()}:
            hashes = ts.gram_hashes(self.words, n)
            owner = self.owner[: len(hashes)]
            own = (owner == self.owner[n - 1 :][: len(hashes)]) & ((sizes[owner] == n) | (n == span)) if len(hashes) else np.zeros(0, bool)
            order = np.lexsort((owner[own], hashes[own]))
            hashes, owner = hashes[own][order], owner[own][order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            self.windows[n] = hashes[new], owner[new]


def _runs(keys: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of equal values: the index in probe, and in the sorted keys."""
    low = np.searchsorted(keys, probe, side="left")
    count = np.searchsorted(keys, probe, side="right") - low
    who = np.repeat(np.arange(len(probe)), count)
    step = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    return who, np.repeat(low, count) + step


def _near(hashes: np.ndarray, first: np.ndarray, grams: np.ndarray, span: int, k: int) -> np.ndarray:
    """Places of windows of ``span`` words with a kept gram that the benchmark keeps too."""
    at, kept = _kept(hashes, first, k, span - k + 1)
    if not len(grams) or not len(at):
        return np.zeros(0, np.int64)
    at = at[grams[np.minimum(np.searchsorted(grams, kept), len(grams) - 1)] == kept]
    places = (at[:, None] - np.arange(span - k + 1)[None, :]).ravel()
    return np.unique(places[places >= 0])


def _spans(block: _Block, hashes: np.ndarray, first: np.ndarray, span: int, k: int) -> list[tuple[int, int, int]]:
    """(item, start, end) of the longest runs of windows that an item has too, in words of the buffer."""
    found = []
    ends = np.repeat(first[1:], np.diff(first))
    for n, (windows, item) in block.windows.items():
        grams = ts.gram_hashes(hashes, n)
        places = np.arange(len(grams)) if n < span else _near(hashes, first, block.grams, span, k)
        places = places[places < len(grams)]
        places = places[places + n <= ends[places]]
        if not len(places) or not len(windows):
            continue
        who, key = _runs(windows, grams[places])
        of, start = item[key], places[who]
        order = np.lexsort((start, of))
        of, start = of[order], start[order]
        # windows in a row are one span; a short item is one window each time
        new = np.ones(len(of), bool)
        if n == span:
            new[1:] = (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1) | (ends[start[1:]] != ends[start[:-1]])
        at = np.flatnonzero(new)
        last = np.concatenate((at[1:], [len(of)])) - 1 if len(at) else at
        found += zip(of[at].tolist(), start[at].tolist(), (start[last] + n).tolist(), strict=True)
    return sorted(found)


def _scan(block, span: int, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value
        for piece in ts.pieces(batches):
            raw, offsets = ts.flat(piece.column("text"))
            raw = ts.LOWER[raw]
            starts, ends, first = ts.words(raw, offsets, ts.ALNUM_WORD)
            hashes = ts.span_hashes(ts.prefix_hashes(raw), starts, ends)
            runs: list[list[dict]] = [[] for _ in range(piece.num_rows)]
            if len(hashes):
                for item, a, b in _spans(known, hashes, first, span, k):
                    doc = int(np.searchsorted(first, a, side="right")) - 1
                    runs[doc].append({"item_id": known.ids[item], "start": a - int(first[doc]), "end": b - int(first[doc])})
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.diff(first)), pa.array(runs, _SPANS)], names=["doc_id", "n_words", "spans"]
            )

    return scan


_SPANS = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def shared_spans(docs: DataFrame, benchmark: DataFrame, span_words: int = 13, gram_words: int = GRAM_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (item_id, start, end in words, end exclusive).

    A span is a longest run of windows of ``span_words`` words that an item has too, or a
    whole item that is shorter, wherever it stands.
    Null and empty texts have no words and no spans; items without words match
    nothing; items without item_id match like others, under a null item_id; repeated rows each get their row; an empty benchmark gives no spans.
    Other columns are not read. Only ``doc_id`` and ``text`` (``item_id`` and
    ``text``) are taken, so columns of any other name do no harm.
    """
    return _row_spans(docs, benchmark, span_words, gram_words, block_bytes).select("doc_id.doc_id", "n_words", "spans")


def _row_spans(docs: DataFrame, benchmark: DataFrame, span_words: int = 13, gram_words: int = GRAM_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``shared_spans`` with doc_id a struct of the id and ``text``, the hash of the row's text."""
    k = min(gram_words, span_words)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("text")))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    parts = []
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        block = docs.sparkSession.sparkContext.broadcast(_Block([tuple(r) for r in rows], span_words, k))
        schema = "doc_id struct<doc_id:long,text:long>, n_words long, spans array<struct<item_id:string,start:long,end:long>>"
        parts.append(docs.mapInArrow(_scan(block, span_words, k), schema).withColumn("part", F.lit(i)))
    if n == 1:
        return parts[0].drop("part")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    # a row that is repeated has the same spans in every copy: they are put together once and dealt out again
    return (
        whole.groupBy("doc_id")
        .agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.count_if(F.col("part") == 0).cast("int").alias("copies"))
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
        .select("doc_id", "n_words", "spans")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, span_words: int = 13, one_in: int = ONE_IN, **options) -> DataFrame:
    """``shared_spans`` with n_hit (distinct words inside spans), items (sorted ids) and contaminated.

    Words that an item without id hits count; a null id is not listed.

    A document is contaminated when n_hit > 0 and one_in * n_hit >= n_words.
    """
    return _judged(shared_spans(docs, benchmark, span_words, **options), one_in)


def _judged(found: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """n_hit, items and contaminated from spans."""
    # spans sorted by start: each adds what lies beyond the furthest end so far
    covered = F.aggregate(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["to"]))).alias("n"), F.greatest(acc["to"], s["b"]).alias("to")),
        lambda acc: acc["n"],
    )
    return found.withColumn("n_hit", covered).withColumn("items", F.array_sort(F.array_compact(F.array_distinct(F.col("spans.item_id"))))).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, one_in: int = ONE_IN, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    It is decided per row, known by doc_id and text: other texts under the same id
    stay, and so do other rows without doc_id.
    """
    bad = _judged(_row_spans(docs, benchmark, **options), one_in).where("contaminated")
    bad = bad.select(F.col("doc_id.doc_id").alias("__bad_id"), F.col("doc_id.text").alias("__bad_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["__bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["__bad_text"])
    return docs.join(bad, same, "left_anti")
