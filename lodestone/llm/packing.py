"""Documents packed into sequences of a fixed number of tokens, in their order.

The token ids of the documents of a partition, laid end to end, are cut into windows of ``SIZE`` ids at most. A window may
be cut at the end of a document, at the end of a sentence, and every ``STRETCH`` ids where neither comes. What a cut costs is
told in ids: nothing at a document's end, ``SENTENCE`` at a sentence's, ``INSIDE`` elsewhere. A window costs its padding: the
ids that lack to ``SIZE``, none where its length is a power of two. Windows are chosen by dynamic programming over the cuts: the least
cost up to a cut is that up to an earlier one, at most ``SIZE`` ids before it, and the window between. Padding falls by one for each id,
so the best earlier cut is the head of a monotone queue; windows with a power of two of ids, an eighth of ``SIZE`` at least, are looked up beside it.

Nothing is shuffled. A task reads its documents as a stream: where the ways of all cuts that can still be continued meet, what
lies before is settled and leaves the task. Ways that don't meet within ``LOOKAHEAD`` ids (as where all cuts lie on one grid) are settled
along the cheapest of them, which costs one window's padding at most. The last window of each partition is all that partitions cost.

Words are tokenized once: white space parts tokens in the vocabularies that this is made for, so the ids of a text are those of its words.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts

#: Ids of a sequence.
SIZE = 2048
#: Ids from one cut to the next where there is no end of a sentence or document.
STRETCH = 64
#: Windows with a power of two of ids, and so without padding, are taken down to this part of a sequence.
SHORTEST = 8
#: What a cut behind a sentence, and one inside, costs.
SENTENCE, INSIDE = 4, 24
#: Ids that may wait for ways to meet.
LOOKAHEAD = 1 << 20
#: Places for words whose ids a Python worker keeps, as a power of two, and ids it keeps at most.
CACHE_BITS, CACHE_IDS = 21, 1 << 24
#: New words that go to the tokenizer as one text, if they are letters and marks behind them.
JOINED = 64
MARKS = ".,;:!?"
#: The id behind each document, in the public vocabulary of 49,408 ids.
END_ID = 1


class Tokens:
    """Ids of words, each distinct word tokenized once; kept by a worker for the tasks that come after.

    A word's place is given by its hash; a word that comes later takes the place of another.
    """

    kept: dict[str, Tokens] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def clear(self) -> None:
        self.hash, self.at = np.zeros(1 << CACHE_BITS, np.uint64), np.zeros(1 << CACHE_BITS, np.int64)
        self.size = np.zeros(1 << CACHE_BITS, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and sizes of words of letters, with or without marks behind them, many to a text; None if their parts can't be told apart."""
        parts = np.fromiter((1 + (w[-1] in MARKS) for w in words), np.int64, len(words))
        texts = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != parts.sum():
            return None
        return ids, np.diff(ends[parts.cumsum() - 1], prepend=0)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new words begin in ``flat``, and how many they are."""
        # lower case in one step and in two must both be letters, as the vocabulary's own lower case may come apart
        plain = np.fromiter((w.rstrip(MARKS).isalpha() and w.rstrip(MARKS).lower().isalpha() for w in words), bool, len(words))
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for chosen in (plain, ~plain):
            some = [words[i] for i in np.flatnonzero(chosen)]
            if not some:
                continue
            ids, sizes = (self._plain(some) if chosen is plain else None) or self._each(some)
            need = self.used + len(ids)
            if need > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(need, np.uint32)))
            self.flat[self.used : need] = ids
            first[chosen], size[chosen] = self.used + sizes.cumsum() - sizes, sizes
            self.used = need
        return first, size

    def encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        if self.used > CACHE_IDS:
            self.clear()
        hashes = ts.span_hashes(ts.prefix_hashes(raw), starts, ends)
        place = (hashes >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        at, size = self.at[place], self.size[place].astype(np.int64)
        new = np.flatnonzero((self.hash[place] != hashes) | (size == 0))
        if len(new):
            distinct, one, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            data, one = raw.tobytes(), new[one]
            first, sizes = self._new([data[a:b].decode() for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
            at[new], size[new] = first[inverse], sizes[inverse]
            self.hash[place[one]], self.at[place[one]], self.size[place[one]] = distinct, first, sizes
        begin = np.cumsum(size) - size
        return self.flat[np.repeat(at - begin, size) + np.arange(size.sum())], size


def tokenized(tokens: Tokens, raw: np.ndarray, offsets: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, each with ``end_id`` behind it; where each text's begin; and the ids before which a sentence ends, a text's end not among them."""
    starts, ends, first = ts.words(raw, offsets, ts.SPACED_WORD)
    ids, size = tokens.encode(raw, starts, ends)
    upto = np.concatenate(([0], size.cumsum()))
    n = len(offsets) - 1
    begin = upto[first] + np.arange(n + 1)
    out = np.full(len(ids) + n, end_id, np.uint32)
    owner = ts.owners(first)
    out[np.arange(len(ids)) + np.repeat(owner, size)] = ids
    closing = np.isin(raw[ends - 1], np.frombuffer(b".?!", np.uint8)) if len(ends) else np.zeros(0, bool)
    behind = np.minimum(ends, max(0, len(raw) - 1))
    closing |= (ends < len(raw)) & (raw[behind] == 10) if len(ends) else closing
    return out, begin, (upto[1:] + owner)[closing]


class Windows:
    """The cheapest windows over a growing row of cuts."""

    def __init__(self, size: int = SIZE, lookahead: int = LOOKAHEAD) -> None:
        self.size, self.lookahead = size, lookahead
        self.place, self.price, self.cost, self.back = [0], [0], [0], [-1]
        self.queue, self.head = [0], 0

    def extend(self, places: np.ndarray, prices: np.ndarray) -> None:
        """Further cuts, in order, and what each costs; neighbours lie at most a window apart."""
        place, cost, back, queue, head, size = self.place, self.cost, self.back, self.queue, self.head, self.size
        short: dict[int, list[int]] = {}
        known = np.concatenate((np.array(place, np.int64), places))
        power = size // SHORTEST
        while power < size:
            at = np.minimum(np.searchsorted(known, places - power), len(known) - 1)
            for j in np.flatnonzero(known[at] == places - power).tolist():
                short.setdefault(j, []).append(int(at[j]))
            power *= 2
        for j, (p, price) in enumerate(zip(places.tolist(), prices.tolist(), strict=True)):
            while place[queue[head]] < p - size:
                head += 1
            best = queue[head]
            least = cost[best] + size - p + place[best]
            for i in short.get(j, ()):
                if cost[i] < least:
                    least, best = cost[i], i
            least += price
            value, i = least + p, len(place)
            place.append(p)
            self.price.append(price)
            cost.append(least)
            back.append(best)
            while len(queue) > head and cost[queue[-1]] + place[queue[-1]] > value:
                queue.pop()
            queue.append(i)
        self.head = head

    def settled(self, final: bool = False) -> list[int]:
        """Ends of windows that are certain (all of them if nothing follows); what lies before them is forgotten."""
        last = len(self.place) - 1
        waiting = self.place[last] - self.place[0]
        live = set(range(bisect_left(self.place, self.place[last] - self.size), last + 1))
        forced = not final and waiting > self.lookahead
        if final:
            meet = last
        elif forced:
            meet = min(live, key=lambda i: (self.cost[i] - self.place[i], i))
        else:
            while len(live) > 1:
                top = max(live)
                live.discard(top)
                live.add(max(self.back[top], 0))
            meet = live.pop()
        ends, i = [], meet
        while i > 0:
            ends.append(self.place[i])
            i = self.back[i]
        later = np.array(self.place[meet + 1 :], np.int64), np.array(self.price[meet + 1 :], np.int64)
        for kept in (self.place, self.price, self.cost, self.back):
            del kept[:meet]
        self.back[:] = [i - meet for i in self.back]
        self.queue, self.head = [i - meet for i in self.queue[self.head :] if i >= meet] or [0], 0
        if forced:
            for kept in (self.place, self.price, self.cost, self.back):
                del kept[1:]
            self.queue = [0]
            self.extend(*later)
        return ends[::-1]


def cuts(begin: np.ndarray, sentences: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may be cut, in order, and what it costs: behind texts, behind sentences, and where neither comes for long."""
    places = np.unique(np.concatenate((begin[1:], sentences)))
    gaps = np.diff(places, prepend=0)
    more = np.maximum(gaps - 1, 0) // stretch
    owner = np.repeat(np.arange(len(places)), more)
    inside = (places - gaps)[owner] + (np.arange(more.sum()) - (np.cumsum(more) - more)[owner] + 1) * stretch
    prices = np.where(np.isin(places, begin), 0, SENTENCE)
    places, prices = np.concatenate((places, inside)), np.concatenate((prices, np.full(len(inside), INSIDE)))
    order = np.argsort(places, kind="stable")
    return places[order], prices[order]


class _Stream:
    """Texts whose ids are not all in sequences yet: the flat ids from ``base`` on, and the texts that reach into them."""

    def __init__(self, kind: pa.DataType, part: int, size: int) -> None:
        self.windows, self.size = Windows(size), size
        self.ids, self.base = np.zeros(0, np.uint32), 0
        self.begin, self.names = np.zeros(1, np.int64), pa.array([], kind)
        self.next = part << 33

    def add(self, names: pa.Array, ids: np.ndarray, begin: np.ndarray, sentences: np.ndarray) -> None:
        at = int(self.begin[-1])
        self.ids = np.concatenate((self.ids, ids))
        self.begin = np.concatenate((self.begin, begin[1:] + at))
        self.names = pa.concat_arrays([self.names, names])
        places, prices = cuts(begin, sentences)
        self.windows.extend(places + at, prices)

    def leave(self, final: bool = False) -> pa.RecordBatch:
        """The pieces of the windows that are settled."""
        ends = np.array(self.windows.settled(final), np.int64)
        stop = int(ends[-1]) if len(ends) else self.base
        windows = np.concatenate(([self.base], ends[:-1])) if len(ends) else ends
        edges = np.unique(np.concatenate((windows, self.begin[(self.begin >= self.base) & (self.begin < stop)])))
        doc = np.searchsorted(self.begin, edges, side="right") - 1
        window = np.searchsorted(windows, edges, side="right") - 1
        to = np.append(edges[1:], stop)[: len(edges)]
        data = memoryview(self.ids.astype("<u4").tobytes())
        checks = [zlib.crc32(data[4 * (a - self.base) : 4 * (b - self.base)]) for a, b in zip(edges.tolist(), to.tolist(), strict=True)]
        total = self.begin[doc + 1] - self.begin[doc] if len(doc) else doc
        columns = [edges - self.begin[doc], to - edges, np.array(checks, np.int64), total, self.next + window, edges - windows[window]]
        batch = pa.RecordBatch.from_arrays([self.names.take(pa.array(doc)), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", *_PIECE])
        self.next += len(windows)
        first = int(np.searchsorted(self.begin, stop, side="right")) - 1
        self.ids, self.base = self.ids[stop - self.base :], stop
        self.begin, self.names = self.begin[first:], self.names.slice(first)
        return batch


_PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _pack_task(path: str, end_id: int, size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, tokens = None, Tokens.of(path)
        for piece in ts.pieces(batches):
            stream = stream or _Stream(piece.column("doc_id").type, TaskContext.get().partitionId(), size)
            raw, offsets = ts.flat(piece.column("text"))
            stream.add(piece.column("doc_id"), *tokenized(tokens, raw, offsets, end_id))
            yield stream.leave()
        if stream:
            yield stream.leave(final=True)

    return pack


def pack(docs: DataFrame, path: str, end_id: int = END_ID, size: int = SIZE) -> DataFrame:
    """One row per piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` is a file of the ``tokenizers`` library on every machine, of a vocabulary whose tokens don't reach across white space.
    Null and empty texts are their ``end_id`` alone. Documents stay in the order of the table's partitions; repeated rows, and rows without
    doc_id, are packed like others. An empty table has no sequences. Sequences are numbered by partition. Only doc_id and text are read.
    """
    if size < STRETCH or size & (size - 1):
        raise ValueError("size must be a power of two, and a stretch at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack_task(path, end_id, size), ", ".join(f"{c} long" for c in ("doc_id", *_PIECE)))
