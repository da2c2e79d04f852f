"""Runs of repeated words in documents, found with suffix automata.

A run is a stretch of words with smallest period q (words q apart are identical), at least ``LEAST_WORDS`` and two
periods long, that no neighbouring word extends. In a document:

1. A run holds a gram of ``GRAM`` words twice, q words apart, and such grams cover all of it. So only stretches of words
   that are covered by grams which stand in the same stretch more than once are looked at; this is repeated until the
   stretches no longer shrink. Most prose has none, and no run crosses the edge of a stretch.
2. For a stretch the suffix automaton is built. From its longest states to its root, the ordered sets of end positions are
   merged along suffix links, the smaller into the larger. Each insertion makes new neighbours; where their distance is at most
   the length of the state, two occurrences of its longest string touch or overlap, which is a square: the seed of a run.
3. Seeds are extended as far as words at their distance are the same. Of equal stretches the smallest distance is the
   period; other distances are its multiples, seen before an occurrence between was inserted.

Documents are looked at one by one, where they lie: nothing is shuffled, and no task holds more than one Arrow batch.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts

#: Least words of a run, and words of the grams that every run repeats: a run of 12 words has 6 pairs of equal words in a row at least.
LEAST_WORDS = 12
#: What parts words.
BLANKS = r"[\x20\x09-\x0D]+"


def gram_words(least: int) -> int:
    """Words of a gram that each run of ``least`` words or more repeats at its period."""
    return max(1, (least + 1) // 2)


def stretches(hashes: np.ndarray, owner: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Starts and ends of the stretches of words that may hold runs; ``owner`` is the document of each word."""
    at = np.arange(len(hashes))
    group = owner.astype(np.int64)
    while len(at) >= gram:
        size = len(at) - gram + 1
        whole = (group[:size] == group[gram - 1 :]) & (at[gram - 1 :] - at[:size] == gram - 1)
        keys = ts.mix(ts.gram_hashes(hashes[at], gram) + ts.mix(group[:size].astype(np.uint64) + np.uint64(1)))
        keys = np.where(whole, keys, 0)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(size, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        twice &= whole
        covered = np.zeros(len(at) + 1, np.int64)
        np.add.at(covered, np.flatnonzero(twice), 1)
        np.add.at(covered, np.flatnonzero(twice) + gram, -1)
        keep = np.flatnonzero(covered.cumsum()[:-1] > 0)
        new = np.ones(len(keep), bool)
        new[1:] = (np.diff(at[keep]) != 1) | (group[keep][1:] != group[keep][:-1])
        done = len(keep) == len(at) and new.sum() == len(np.unique(group))
        at, group = at[keep], new.cumsum()
        if done:
            break
    else:
        return []
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(edges, [*edges[1:], len(at)], strict=True)]


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and lengths of the states of the suffix automaton, and the state of each prefix."""
    step, link, length, prefixes, last = [{}], [-1], [0], [], 0
    for w in words:
        new = len(link)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(link)
                step.append(step[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = twin
                    p = link[p]
        prefixes.append(new)
        last = new
    return link, length, prefixes


def seeds(words: list[int]) -> Iterator[tuple[int, int]]:
    """(end, distance) of squares: an occurrence that ends at ``end`` has another one, of the same string at least so long, ``distance`` before it."""
    link, length, prefixes = automaton(words)
    # positions are kept negated: a state's own end is the least of its set, and goes to the end of the list
    ends: list[list[int]] = [[] for _ in link]
    for i, state in enumerate(prefixes):
        ends[state].append(-i)
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        up = link[state]
        if up <= 0:
            continue
        few, many = ends[state], ends[up]
        ends[state] = []
        if len(few) > len(many):
            few, many = many, few
        most = length[up]
        for x in few:
            i = bisect_left(many, x)
            if i and x - many[i - 1] <= most:
                yield -many[i - 1], x - many[i - 1]
            if i < len(many) and many[i] - x <= most:
                yield -x, many[i] - x
            many.insert(i, x)
        ends[up] = many


def runs(words: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    known: dict[int, list[tuple[int, int]]] = {}
    breaks: dict[int, np.ndarray] = {}
    for end, d in seeds(words.tolist()):
        mine = known.setdefault(d, [])
        if any(a + d <= end < b for a, b in mine):
            continue
        if d not in breaks:
            breaks[d] = np.flatnonzero(words[d:] != words[:-d])
        # words i and i + d are the same from the break before to the break behind
        k = int(np.searchsorted(breaks[d], end - d))
        a = int(breaks[d][k - 1]) + 1 if k else 0
        b = (int(breaks[d][k]) if k < len(breaks[d]) else len(words) - d) + d
        mine.append((a, b))
        if b - a >= max(least, 2 * d):
            found[a, b] = min(d, found.get((a, b), d))
    return sorted((a, b - a, q) for (a, b), q in found.items())


def _run_task(least: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in ts.pieces(batches):
            raw, offsets = ts.flat(piece.column("text"))
            starts, stops, first = ts.words(raw, offsets, ts.SPACED_WORD)
            hashes = ts.span_hashes(ts.prefix_hashes(raw), starts, stops)
            owner = ts.owners(first)
            per: list[list[tuple[int, int, int]]] = [[] for _ in range(piece.num_rows)]
            for a, b in stretches(hashes, owner, gram_words(least)):
                if b - a >= least:
                    codes = np.unique(hashes[a:b], return_inverse=True)[1]
                    of = int(owner[a])
                    per[of] += [(s + a - int(first[of]), n, q) for s, n, q in runs(codes, least)]
            data, texts = raw.tobytes(), []
            for i, own in enumerate(per):
                words = data[offsets[i] : offsets[i + 1]].split()
                if own:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s, n, q in own:
                        gone[s + q] += 1
                        gone[s + n] -= 1
                    words = [words[j] for j in np.flatnonzero(gone.cumsum()[:-1] == 0)]
                texts.append(b" ".join(words))
            lists = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in sorted(own, key=lambda r: (r[0], r[2]))] for own in per], kind)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(first)), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return search


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of every row of ``docs``.

    Words are what blanks and line ends part, and are numbered from 0; they are compared by 64-bit hash. ``collapsed`` has the words that no
    run drops, joined by single spaces: of a run the words behind its first period go. Null and empty texts have no words, no
    runs and an empty text. Repeated rows, and rows without doc_id, each get their row. Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "array<struct<start: long, length: long, period: long>>"
    return rows.mapInArrow(_run_task(least), f"doc_id long, n_words long, runs {kind}, collapsed string")


def stuttered(text: Column, doc_id: Column) -> Column:
    """The text with one document in ten, by the checksum h of its id, made periodic from some word on.

    With g = h div 10 and n words, word i from a = g mod n on becomes word a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8).
    Texts without words, and those without id, stay as they are; so do blanks of texts that are not changed.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % F.nullif(n, F.lit(0))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        pick = lambda x, i: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int")
        made = F.transform(F.array(F.struct(words.alias("w"), a.alias("a"), p.alias("p"))), lambda x: F.array_join(F.transform(x["w"], lambda _, i: F.get(x["w"], pick(x, i))), " "))
        return made[0]

    words = F.filter(F.split(text, BLANKS, -1), lambda w: w != "")
    periodic = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, changed(w)).otherwise(text))[0]
    return F.when(h % 10 == 0, periodic).otherwise(text)
