"""Sentence packing with word overlap, as Column expressions.

Which sentences make a chunk depends on their word counts alone, so the fold
carries numbers, and texts are put together once from slices. The words that a
chunk takes over from the one before are the last ones before its first sentence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim, word_count, words

CHUNK_WORDS, OVERLAP_WORDS = 512, 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often (and within which lambdas) it is used."""
    return F.transform(F.array(value), body)[0]


def should_chunk(text: Column, chunk_words: int = CHUNK_WORDS) -> Column:
    return word_count(text) > chunk_words


def sentences(text: Column) -> Column:
    """Each ``.``, ``?`` or ``!`` ends a sentence at once; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, "(?<=[.?!])", -1), trim), lambda s: s != "")


def chunk_text(text: Column, chunk_words: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """Array of chunks; a text of ``chunk_words`` words or fewer is one chunk, as it is."""

    def packed(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("held"), F.lit(0).alias("seen"), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("seen"), F.lit(0).alias("over"))).alias("cuts"))

        def step(acc: Column, n: Column) -> Column:
            full = (acc["held"] + n > chunk_words) & (acc["i"] > 0)
            over = F.least(F.lit(overlap), acc["held"])
            cut = F.struct(acc["i"].alias("i"), acc["seen"].alias("seen"), over.alias("over"))
            return F.struct(
                (acc["i"] + 1).alias("i"),
                F.when(full, over + n).otherwise(acc["held"] + n).alias("held"),
                (acc["seen"] + n).alias("seen"),
                F.when(full, F.array_append(acc["cuts"], cut)).otherwise(acc["cuts"]).alias("cuts"),
            )

        cuts = F.aggregate(F.transform(parts, word_count), start, step, lambda acc: acc["cuts"])
        bound = F.struct(parts.alias("parts"), F.flatten(F.transform(parts, words)).alias("words"), cuts.alias("cuts"))
        return let(bound, glued)

    def glued(b: Column) -> Column:
        def one(cut: Column, k: Column) -> Column:
            until = F.coalesce(F.get(b["cuts"], k + 1)["i"], F.size(b["parts"]))
            own = F.array_join(F.slice(b["parts"], cut["i"] + 1, until - cut["i"]), " ")
            taken = F.array_join(F.slice(b["words"], cut["seen"] - cut["over"] + 1, cut["over"]), " ")
            return F.when(k == 0, own).otherwise(F.concat(taken, F.lit(" "), own))

        return F.transform(b["cuts"], one)

    return F.when(should_chunk(text, chunk_words), let(sentences(text), packed)).otherwise(F.array(text))
