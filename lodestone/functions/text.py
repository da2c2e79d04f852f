"""Text as Column expressions: tokens, words, tags, previews. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that an index leaves out.
STOPWORDS = (
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will would "
    "could should may might shall can not no nor so yet both either neither this that these those it its they them their"
).split()

#: What is neither alphabetic nor a number parts tokens; Java's \s knows ASCII only, hence the property.
SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"
WHITESPACE = r"\p{IsWhite_Space}+"
_EDGES = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"


def pieces(text: Column) -> Column:
    """Lower-cased runs of letters and digits, empty ones included. Split first: a lower-cased letter may be two characters."""
    return F.transform(F.split(text, SEPARATORS, -1), F.lower)


def terms(text: Column) -> Column:
    """Index terms with repetitions: 3 bytes or more and no stopword."""
    return F.filter(pieces(text), lambda w: (F.octet_length(w) >= 3) & ~w.isin(*STOPWORDS))


def tokenize(text: Column) -> Column:
    """Index tokens: ``terms``, the first occurrence of each."""
    return F.array_distinct(terms(text))


def tokenize_query(text: Column) -> Column:
    """Query tokens: 2 bytes or more, stopwords kept, the first occurrence of each."""
    return F.array_distinct(F.filter(pieces(text), lambda w: F.octet_length(w) >= 2))


def words(text: Column) -> Column:
    """What Unicode whitespace parts."""
    return F.filter(F.split(text, WHITESPACE, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def trim(text: Column) -> Column:
    """Without Unicode whitespace at both ends."""
    return F.regexp_replace(text, _EDGES, "")


def collapse(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.array_join(words(text), " ")


def strip_tags(markup: Column) -> Column:
    """Without tags (an open one runs to the end) and stray ``>``; whitespace collapsed, entities left alone."""
    return collapse(F.regexp_replace(markup, "<[^>]*(>|$)|>", ""))


def preview_filename(name: Column) -> Column:
    """At most 18 characters: longer names are cut at 16."""
    return F.when(F.char_length(name) > 18, F.concat(F.substring(name, 1, 16), F.lit(".."))).otherwise(name)


def preview_summary(summary: Column) -> Column:
    """One line of at most 50 characters."""
    line = F.regexp_replace(summary, "\n", " ")
    return F.when(F.char_length(line) > 50, F.concat(F.substring(line, 1, 47), F.lit("..."))).otherwise(line)
