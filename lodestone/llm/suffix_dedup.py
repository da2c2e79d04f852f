"""Exact removal of repeated byte strings by distributed sorting of suffixes.

A byte goes when a string of ``SPAN`` bytes that covers it also starts in a
document with a smaller doc_id. To sort all suffixes is not needed to find these:

1. Exact copies of a text go whole and take no part in what follows.
2. Anchors: each string of SPAN bytes belongs to the gram of ``GRAM`` bytes inside it that
   has the least hash (the leftmost of equal ones), so equal strings belong to grams at
   the same place inside. Tasks exchange sorted, front-coded runs of the hashes of these
   anchors; those of one document only end here.
3. Each task that has the texts sorts the suffixes that start at the remaining anchors, with
   the bytes to their left, as far as the strings that belong to the anchor reach. Of
   equal ones only those of the least document go on: the others are decided. What is left
   goes to the other tasks as front-coded runs (length of the prefix shared with the suffix
   before, and the rest).
4. The receiving task merges the runs with a loser tree whose players carry the
   length of the prefix they share with the last winner: players that differ in it
   are decided without a look at the bytes, others are compared behind it. The
   merge yields each suffix's common prefix with the one before, from which the
   strings that stand in several documents are read off.
5. All suffixes of one anchor meet in one task. Where an anchor stands in more than
   ``HOT_GROUP`` places, its strings are dealt one by one instead: a task keeps the least
   document of each, and sends sorted runs of their hashes, which are merged like those
   of the anchors. The result is the same whichever way an anchor takes.

Only runs that hold something are sent, so their number grows with the anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import written

#: Length of the strings, of the grams whose hashes anchor them, and what lies to the left of an anchor at most.
SPAN, GRAM = 50, 16
LEFT = SPAN - GRAM
#: Where a text ends; never a byte of UTF-8.
OUTSIDE = 0xFF
#: Bytes of text for each part of the two exchanges.
PART_BYTES = 16 << 20
#: Anchors, suffixes or strings that a task holds before it sends runs off.
ANCHOR_RUN, SUFFIX_RUN, STRING_RUN = 1 << 19, 1 << 18, 1 << 20
#: Places of an anchor beyond which its strings are dealt one by one.
HOT_GROUP = 1 << 13
#: Bits that an anchor's hash has beyond those that number the anchors: of those that share it, so few do by chance.
SPARE_BITS = 6

_RUNS = "part int, run binary"
#: What a run holds: suffixes, hashes, or what is found for the documents of a part.
_SUFFIXES, _STRINGS, _FOUND = 0, 1, 2


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place in the buffer, and first and last start of the strings that belong to it, of each anchor, in order."""
    none = np.zeros(0, np.int64)
    n = len(raw) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none
    at = np.arange(len(raw) - GRAM + 1)
    hashes = ts.span_hashes(ts.prefix_hashes(raw), at, at + GRAM)
    # the least of a window is the least hash, and of equal ones the leftmost
    least = (hashes & np.uint64(0xFFFFFFFF << 32)) | at.astype(np.uint64)
    width, window = 1, SPAN - GRAM + 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    owner = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.arange(n) <= np.repeat(offsets[1:] - SPAN, np.diff(offsets))[:n]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    of = owner[starts]
    new = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    last = np.concatenate((new[1:], [len(starts)])) - 1
    # the least of a window are small numbers: mixed again, they spread over all parts
    return ts.mix(hashes[of[new]] ^ np.uint64(0x9FB21C651E98DF25)), of[new], starts[new], starts[last]


def _numbered(place: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each anchor, and its number among those of the text."""
    of = np.searchsorted(offsets, place, side="right") - 1
    return of, np.arange(len(of)) - np.searchsorted(of, of)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed."""
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    return len(body).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


class _Reader:
    def __init__(self, run: bytes) -> None:
        self.body, self.at = zstandard.ZstdDecompressor().decompress(run[8:], max_output_size=int.from_bytes(run[:8], "little") or 1), 0

    def keys(self, n: int) -> np.ndarray:
        out = np.zeros(n, _KEY)
        out["doc"], out["tag"] = np.cumsum(self.take(n, np.int64)), self.take(n, np.int32)
        return out

    def take(self, n: int, kind: type) -> np.ndarray:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(self.body, np.uint8, n * size, self.at).reshape(size, n)
        self.at += n * size
        return np.ascontiguousarray(planes.T).view(kind).reshape(n)


#: Which text of which document: a second text under one doc_id has another tag.
_KEY = np.dtype([("doc", np.int64), ("tag", np.int32)])


def _keys(piece: pa.RecordBatch) -> np.ndarray:
    keys = np.zeros(piece.num_rows, _KEY)
    keys["doc"], keys["tag"] = piece.column("doc_id").to_numpy(zero_copy_only=False), piece.column("tag").to_numpy()
    return keys


def _key_steps(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys as steps, which compress well."""
    return np.diff(keys["doc"], prepend=0), np.ascontiguousarray(keys["tag"])


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and which of them each is; tags are hardly ever set, and plain numbers sort faster."""
    if keys["tag"].any():
        return np.unique(keys, return_inverse=True)
    docs, which = np.unique(keys["doc"], return_inverse=True)
    out = np.zeros(len(docs), _KEY)
    out["doc"] = docs
    return out, which


def _of_parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _hash_runs(h: np.ndarray, key: np.ndarray, place: np.ndarray, parts: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """Sorted runs of (hash of so many bits, key, place), one for each part that has any."""
    order = np.argsort(h)
    h, key, place = h[order], key[order], place[order]
    cut = np.searchsorted(_of_parts(h, parts), np.arange(parts + 1))
    for part in np.flatnonzero(np.diff(cut)):
        a, b = cut[part], cut[part + 1]
        keys, which = _unique(key[a:b])
        steps = np.diff(h[a:b] >> np.uint64(64 - bits), prepend=np.uint64(0))
        yield int(part), np.array([_STRINGS, b - a, len(keys)], np.int64).tobytes() + _packed(steps, *_key_steps(keys), which.astype(np.uint32), place[a:b].astype(np.uint32))


def _read_hashes(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, their keys and places, from all runs of a part."""
    columns = []
    for run in runs:
        _, n, n_keys = np.frombuffer(run, np.int64, 3)
        reader = _Reader(run[24:])
        h = np.cumsum(reader.take(n, np.uint64), dtype=np.uint64)
        keys = reader.keys(n_keys)
        columns.append((h, keys[reader.take(n, np.uint32)], reader.take(n, np.uint32)))
    runs.clear()
    h, key, place = (np.concatenate(x) for x in zip(*columns, strict=True))
    columns.clear()
    order = np.argsort(h, kind="stable")
    return h[order], key[order], place[order]


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of equal sorted values begins, and its size."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
    return first, np.diff(np.concatenate((first, [len(h)])))


def _run_batch(runs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in runs], pa.int32()), pa.array([r for _, r in runs], pa.binary())], names=["part", "run"])


def _found_runs(key: np.ndarray, one: np.ndarray, other: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Two numbers for each key, as a run for each part that the documents are dealt to: a row for each document and task would be very many."""
    part = _of_parts(ts.mix(key["doc"].astype(np.uint64)), parts)
    order = np.argsort(part, kind="stable")
    key, one, other = key[order], one[order], other[order]
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    runs = []
    for p in np.flatnonzero(np.diff(cut)):
        a, b = cut[p], cut[p + 1]
        keys, which = _unique(key[a:b])
        runs.append((int(p), np.array([_FOUND, b - a, len(keys)], np.int64).tobytes() + _packed(*_key_steps(keys), which.astype(np.uint32), one[a:b].astype(np.int32), other[a:b].astype(np.int32))))
    return runs


def _gather_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the runs of each part: (doc_id, tag, one, other), a row for each document."""
    for _, runs in _by_part(batches):
        columns = []
        for run in runs:
            _, n, n_keys = np.frombuffer(run, np.int64, 3)
            reader = _Reader(run[24:])
            keys = reader.keys(n_keys)
            columns.append((keys[reader.take(n, np.uint32)], reader.take(n, np.int32), reader.take(n, np.int32)))
        yield pa.RecordBatch.from_arrays(_lists(*(np.concatenate(x) for x in zip(*columns, strict=True))), names=["doc_id", "tag", "one", "other"])


def _anchor_task(parts: int, bits: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return _run_batch(list(_hash_runs(*columns, parts, bits)))

        for piece in ts.pieces(batches):
            piece = piece.filter(piece.column("doc_id").is_valid())
            raw, offsets = ts.flat(piece.column("text"))
            h, at, _, _ = anchors(raw, offsets)
            of, number = _numbered(at, offsets)
            held.append((h, _keys(piece)[of], number))
            if sum(len(x[0]) for x in held) > ANCHOR_RUN:
                yield out()
        if held:
            yield out()

    return runs


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """One part after another and its runs, from rows in the order of parts."""
    part, runs = None, []
    for batch in batches:
        column = batch.column("run")
        for i, p in enumerate(batch.column("part").to_pylist()):
            if p != part and runs:
                yield part, runs
                runs = []
            part = p
            runs.append(column[i].as_py())
    if runs:
        yield part, runs


def _lists(key: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """Keys, and for each one list of each kind of value."""
    keys, which = _unique(key)
    order = np.argsort(which, kind="stable")
    at = pa.array(np.searchsorted(which[order], np.arange(len(keys) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(v[order].astype(np.int32))) for v in values]
    return [pa.array(keys["doc"]), pa.array(keys["tag"]), *lists]


def _shared_task(hot_group: int, parts: int):
    """Anchors of two documents or more: their numbers, and whether they are hot."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, runs in _by_part(batches):
            h, key, number = _read_hashes(runs)
            first, size = _groups(h)
            several = np.repeat(np.minimum.reduceat(key["doc"], first) < np.maximum.reduceat(key["doc"], first), size)
            yield _run_batch(_found_runs(key[several], number[several], np.repeat(size > hot_group, size)[several], parts))

    return shared


def _picked(piece: pa.RecordBatch, at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors (by their places) have their numbers in the lists of their texts: those that are not hot, and those that are."""
    of, number = _numbered(at, offsets)
    lists = piece.column("one")
    wanted = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())) << 40 | lists.flatten().to_numpy().astype(np.int64)
    hot = piece.column("other").flatten().to_numpy().astype(bool)
    return np.isin(of << 40 | number, wanted[~hot]), np.isin(of << 40 | number, wanted[hot])


def _contexts(raw: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Bytes from LEFT before each anchor to SPAN behind it, as far as its strings reach; else OUTSIDE."""
    context = np.empty((len(at), LEFT + SPAN), np.uint8)
    for a in range(0, len(at), 8192):
        some = slice(a, a + 8192)
        places = at[some][:, None] + np.arange(-LEFT, SPAN)[None, :]
        out = (places < first[some][:, None]) | (places >= last[some][:, None] + SPAN)
        context[some] = np.where(out, np.uint8(OUTSIDE), raw[np.clip(places, 0, max(len(raw) - 1, 0))])
    return context


def _reach(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest o for which the string from o bytes left of the anchor belongs to it."""
    most = np.where((hole := left[:, ::-1] == OUTSIDE).any(1), hole.argmax(1), LEFT)
    least = np.maximum(0, SPAN - np.where((hole := right == OUTSIDE).any(1), hole.argmax(1), SPAN))
    return least, most


def _suffix_runs(key: np.ndarray, place: np.ndarray, context: np.ndarray, parts: int) -> tuple[list[tuple[int, bytes]], tuple]:
    """Front-coded runs of sorted suffixes, one for each part that has any; and what is decided here: (key, start, end)."""
    words = np.ascontiguousarray(context[:, LEFT : LEFT + GRAM]).view(np.uint64)
    part = _of_parts(ts.mix(ts.mix(words[:, 0]) + words[:, 1]), parts)
    # by the suffix, then by the bytes to the left from right to left
    line = np.concatenate((context[:, LEFT:], context[:, :LEFT][:, ::-1]), axis=1)
    order = np.argsort(line.view(f"S{LEFT + SPAN}").ravel(), kind="stable")
    order = order[np.argsort(part[order], kind="stable")]
    line, key, place, part = line[order], key[order], place[order], part[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]).any(1)
    group = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(key["doc"], group), np.diff(np.concatenate((group, [len(line)]))))
    copy = key["doc"] > least
    near, far = _reach(line[copy, SPAN:][:, ::-1], line[copy, :SPAN])
    decided = (key[copy], place[copy] - far, place[copy] - near + SPAN)
    line, key, place, part = line[~copy], key[~copy], place[~copy], part[~copy]
    cut = np.searchsorted(part, np.arange(parts + 1))
    runs = []
    for p in np.flatnonzero(np.diff(cut)):
        suffix, left = line[cut[p] : cut[p + 1], :SPAN], line[cut[p] : cut[p + 1], SPAN:]
        shared = np.zeros(len(suffix), np.uint8)
        shared[1:] = np.where((same := suffix[1:] == suffix[:-1]).all(1), SPAN, same.argmin(1))
        rest = suffix[np.arange(SPAN)[None, :] >= shared[:, None]]
        change = left.copy()
        change[1:] ^= left[:-1]
        keys, which = _unique(key[cut[p] : cut[p + 1]])
        body = _packed(shared, rest, change.ravel(), *_key_steps(keys), which.astype(np.uint32), place[cut[p] : cut[p + 1]].astype(np.uint32))
        runs.append((int(p), np.array([_SUFFIXES, len(suffix), len(keys), len(rest)], np.int64).tobytes() + body))
    return runs, decided


def _string_runs(h: np.ndarray, key: np.ndarray, start: np.ndarray, parts: int) -> tuple[list[tuple[int, bytes]], tuple]:
    """Runs of the hashes of strings, of the least document only; and what is decided here."""
    order = np.argsort(h, kind="stable")
    h, key, start = h[order], key[order], start[order]
    first, size = _groups(h)
    copy = key["doc"] > np.repeat(np.minimum.reduceat(key["doc"], first), size)
    return list(_hash_runs(h[~copy], key[~copy], start[~copy], parts, 64)), (key[copy], start[copy], start[copy] + SPAN)


def _suffix_task(parts: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold: list[tuple] = []
        hot: list[tuple] = []

        def out(held: list[tuple], make) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            sent, decided = make(*columns, parts)
            yield _run_batch(sent + _found_runs(*decided, parts))

        for piece in ts.pieces(batches):
            raw, offsets = ts.flat(piece.column("text"))
            h, at, first, last = anchors(raw, offsets)
            keys = _keys(piece)
            mine, many_places = _picked(piece, at, offsets)
            of = np.searchsorted(offsets, at[mine], side="right") - 1
            cold.append((keys[of], at[mine] - offsets[of], _contexts(raw, at[mine], first[mine], last[mine])))
            mine = many_places
            if mine.any():
                many = last[mine] - first[mine] + 1
                starts = np.repeat(first[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                of = np.searchsorted(offsets, starts, side="right") - 1
                hot.append((ts.mix(ts.span_hashes(ts.prefix_hashes(raw), starts, starts + SPAN)), keys[of], starts - offsets[of]))
            if sum(len(x[0]) for x in cold) > SUFFIX_RUN:
                yield from out(cold, _suffix_runs)
            if sum(len(x[0]) for x in hot) > STRING_RUN:
                yield from out(hot, _string_runs)
        if sum(len(x[0]) for x in cold):
            yield from out(cold, _suffix_runs)
        if hot:
            yield from out(hot, _string_runs)

    return runs


class _Run:
    """A run as it was sent: sorted suffixes, their common prefixes, and where they come from."""

    def __init__(self, run: bytes) -> None:
        _, n, n_keys, n_rest = np.frombuffer(run, np.int64, 4)
        reader = _Reader(run[32:])
        self.shared = reader.take(n, np.uint8)
        rest = reader.take(n_rest, np.uint8)
        self.left = np.bitwise_xor.accumulate(reader.take(n * LEFT, np.uint8).reshape(n, LEFT), axis=0)[:, ::-1]
        keys = reader.keys(n_keys)
        self.key, self.place = keys[reader.take(n, np.uint32)], reader.take(n, np.uint32).astype(np.int64)
        own = SPAN - self.shared.astype(np.int64)
        begin = np.cumsum(own) - own
        self.right = np.empty((n, SPAN), np.uint8)
        for c in range(SPAN):
            # the last suffix that brought its own byte at this column
            source = np.maximum.accumulate(np.where(self.shared <= c, np.arange(n), 0))
            self.right[:, c] = rest[begin[source] + c - self.shared[source]] if n else 0


#: What of a suffix, as an integer, lies behind a known prefix of each length.
_BEHIND = [(1 << (8 * (SPAN - n))) - 1 for n in range(SPAN + 1)]


def merge(runs: list[list[int]], shared: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Loser tree over sorted runs of SPAN-byte suffixes (as integers) with their common prefixes.

    Gives the run and index of each suffix in order, and the length of the prefix
    it shares with the one before. ``prefix`` of a player is what it shares with the
    last winner (for a loser, with the player that beat it there); -1 for a run that is
    at its end. Of two players the longer prefix wins; only players with equal prefixes
    are compared, and only the bytes behind these.
    """
    k = len(runs)
    at = [0] * k
    value = [r[0] if r else 0 for r in runs]
    prefix = [0 if r else -1 for r in runs]
    tree = [-1] * k
    whole = 8 * SPAN

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser of two players that share equally much with the last winner."""
        behind = _BEHIND[prefix[i]]
        a, b = value[i] & behind, value[j] & behind
        if a > b:
            i, j = j, i
        prefix[j] = (whole - (a ^ b).bit_length()) >> 3
        return i, j

    def build(node: int) -> int:
        if node >= k:
            return node - k
        i, j = build(2 * node), build(2 * node + 1)
        # nothing has won yet, so all are compared from the first byte; empty runs lose
        w, tree[node] = play(i, j) if prefix[i] == prefix[j] == 0 else (i, j) if prefix[j] < 0 else (j, i)
        return w

    winner = build(1) if k > 1 else 0
    of_run, index, common = [], [], []
    while k and prefix[winner] >= 0:
        i = at[winner]
        of_run.append(winner)
        index.append(i)
        common.append(prefix[winner])
        i += 1
        at[winner] = i
        run = runs[winner]
        if i < len(run):
            value[winner], prefix[winner] = run[i], shared[winner][i]
        else:
            prefix[winner] = -1
        node = (winner + k) >> 1
        while node:
            other = tree[node]
            mine, its = prefix[winner], prefix[other]
            if its > mine:
                tree[node], winner = winner, other
            elif its == mine >= 0:
                winner, tree[node] = play(winner, other)
            node >>= 1
    return of_run, index, common


def _repeats(doc: np.ndarray, left: np.ndarray, right: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in order: least and largest o for which the string from o bytes left of the anchor stands in a smaller document (35 and -1 if none)."""
    n = len(doc)
    low, high = np.full(n, LEFT + 1), np.full(n, -1)
    least_o, most_o = _reach(left, right)

    def further(sums: np.ndarray, o: int, which: np.ndarray) -> np.ndarray:
        """Hashes of o bytes to the left, from those of one less."""
        return ts.mix(sums * np.uint64(0x9E3779B97F4A7C55) + left[which, LEFT - o].astype(np.uint64) + np.uint64(1))

    def smaller(which: np.ndarray, runs: np.ndarray, lefts_: np.ndarray) -> np.ndarray:
        # the two parts must not be exchangeable: a left byte of 4 in run 9 is not one of 9 in run 4
        key = ts.mix(lefts_ * np.uint64(0x9E3779B97F4A7C55) + ts.mix(runs.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        least = np.repeat(np.minimum.reduceat(doc[which][order], first), np.diff(np.concatenate((first, [len(key)]))))
        out = np.empty(len(which), bool)
        out[order] = doc[which][order] > least
        return out

    if not n:
        return low, high
    # whole contexts that a smaller document has too are done with; the others go on
    every, sums = np.arange(n), np.zeros(n, np.uint64)
    for o in range(1, LEFT + 1):
        sums = further(sums, o, every)
    copy = smaller(every, np.cumsum(common < SPAN), sums)
    whole = copy & (least_o <= most_o)
    low[whole], high[whole] = least_o[whole], most_o[whole]
    rest = every[~copy]
    # two of them share the least that neighbours between them share
    between = np.minimum.reduceat(np.concatenate((common[1:], [0])), rest)
    near = np.concatenate(([0], between[:-1]))
    # a suffix whose neighbours share less than the anchor with it is alone
    company = (near >= GRAM) | (np.concatenate((near[1:], [0])) >= GRAM)
    sums = np.zeros(len(rest), np.uint64)
    for o in range(LEFT + 1):
        sums = further(sums, o, rest) if o else sums
        runs = np.cumsum(near < SPAN - o)
        use = company & (least_o[rest] <= o) & (most_o[rest] >= o)
        which = rest[use]
        if not len(which):
            continue
        hit = which[smaller(which, runs[use], sums[use])]
        low[hit], high[hit] = np.minimum(low[hit], o), np.maximum(high[hit], o)
    return low, high


def _merged_suffixes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, start and end of what goes, from the runs of suffixes of a part."""
    runs = [_Run(b) for b in blobs]
    blobs.clear()
    data = [r.right.tobytes() for r in runs]
    values = [[int.from_bytes(d[i : i + SPAN], "big") for i in range(0, len(d), SPAN)] for d in data]
    of_run, index, common = merge(values, [r.shared.tolist() for r in runs])
    base = np.concatenate(([0], np.cumsum([len(r.key) for r in runs])))
    order = base[np.array(of_run)] + np.array(index)
    key, place, left, right = (np.concatenate([getattr(r, c) for r in runs])[order] for c in ("key", "place", "left", "right"))
    low, high = _repeats(np.ascontiguousarray(key["doc"]), left, right, np.array(common))
    hit = high >= 0
    return key[hit], place[hit] - high[hit], place[hit] - low[hit] + SPAN


def _merged_strings(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, start and end of what goes, from the runs of strings of a part."""
    h, key, start = _read_hashes(blobs)
    first, size = _groups(h)
    hit = key["doc"] > np.repeat(np.minimum.reduceat(key["doc"], first), size)
    return key[hit], start[hit].astype(np.int64), start[hit].astype(np.int64) + SPAN


def _merge_task(parts: int):
    """From the runs of each part: starts and ends of the bytes that go; what was decided before passes."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in _by_part(batches):
            kind = [int(np.frombuffer(b, np.int64, 1)[0]) for b in blobs]
            of = lambda k: [b for b, x in zip(blobs, kind, strict=True) if x == k]  # noqa: E731, B023
            made = [make(own) for make, own in ((_merged_suffixes, of(_SUFFIXES)), (_merged_strings, of(_STRINGS))) if own]
            for figures in made:
                yield _run_batch(_found_runs(*figures, parts))
            found = of(_FOUND)
            if found:
                yield _run_batch([(part, b) for b in found])

    return merged


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in ts.pieces(batches):
        raw, offsets = ts.flat(piece.column("text"))
        starts, ends = (piece.column(c) for c in ("starts", "ends"))
        n_bytes = np.diff(offsets)
        n_removed, n_spans, kept = [], [], []
        for i, copy in enumerate(piece.column("copy").to_pylist()):
            own = raw[offsets[i] : offsets[i + 1]]
            if copy and len(own) >= SPAN:
                runs = np.array([[0, len(own)]])
            elif starts[i].as_py():
                a, b = np.sort(starts[i].values.to_numpy()), np.sort(ends[i].values.to_numpy())
                # a run begins where all spans before have ended; equal spans sort alike at both ends
                new = np.concatenate(([True], a[1:] > b[:-1]))
                runs = np.stack((a[new], b[np.concatenate((new[1:], [True]))]), axis=1)
            else:
                runs = np.zeros((0, 2), np.int64)
            edges = [0, *runs.ravel().tolist(), len(own)]
            n_removed.append(int((runs[:, 1] - runs[:, 0]).sum()))
            n_spans.append(len(runs))
            kept.append(b"".join(own[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
        arrays = [piece.column("doc_id"), pa.array(n_bytes), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut_task(batches):
        digests = pa.array([hashlib.sha256(x).hexdigest() for x in batch.column("kept").to_pylist()], pa.string())
        yield batch.drop_columns(["kept"]).append_column("kept_sha256", digests)


def removed_spans(docs: DataFrame, hot_group: int = HOT_GROUP) -> DataFrame:
    """(doc_id, text, copy, starts, ends) of every row: the bytes that go, as byte offsets that may overlap; all of a copy."""
    spark = docs.sparkSession
    every = docs.select("doc_id", "text")
    if every.dtypes != [("doc_id", "bigint"), ("text", "string")]:
        every = every.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = every.where("doc_id is not null")
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    digest = named.where("text is not null").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    # texts that share a doc_id are told apart by a tag; there are hardly ever any
    several = digest.groupBy("doc_id").agg((F.min("h1") < F.max("h1")).alias("several")).where("several")
    tag = F.when(F.col("several"), F.pmod(F.col("h1"), F.lit((1 << 31) - 1))).otherwise(0).cast("int").alias("tag")
    least = digest.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "least")
    # a table of its own: the join then has an exchange on either side, and a text with very many copies can be split
    least = written(least, "copied-texts")
    copies = digest.join(least, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where("doc_id > least").select("doc_id", "h1").distinct()
    copies = copies.join(several, "doc_id", "left").select("doc_id", tag, F.lit(True).alias("copy"))

    def by_id(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """Joined on doc_id and tag; only the first is a key of the join, so that the exchange of the texts serves."""
        right = right.withColumnsRenamed({"doc_id": "__id", "tag": "__tag"}).hint("shuffle_hash")
        return left.join(right, (F.col("doc_id") == F.col("__id")) & (F.col("tag") - F.col("__tag") == 0), how).drop("__id", "__tag")

    # one exchange of the texts serves the anchors, the suffixes and the cut
    texts = named.repartition(parts, "doc_id").join(several.hint("shuffle_hash"), "doc_id", "left").withColumn("h1", F.xxhash64("text")).select("doc_id", tag, "text")
    texts = by_id(texts, copies, "left")
    single = texts.where("copy is null").drop("copy")
    dealt = lambda runs: runs.repartitionById(parts, "part").sortWithinPartitions("part")
    gathered = lambda found: dealt(found).mapInArrow(_gather_task, "doc_id long, tag int, one array<int>, other array<int>")
    bits = min(64, max(32, int(size // LEFT).bit_length() + SPARE_BITS))
    shared = gathered(dealt(single.mapInArrow(_anchor_task(parts, bits), _RUNS)).mapInArrow(_shared_task(hot_group, parts), _RUNS))
    wanted = by_id(single, shared, "inner").select("doc_id", "tag", "text", "one", "other")
    listed = gathered(dealt(wanted.mapInArrow(_suffix_task(parts), _RUNS)).mapInArrow(_merge_task(parts), _RUNS)).withColumnsRenamed({"one": "starts", "other": "ends"})
    marked = by_id(texts, listed, "left")
    marked = marked.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts", "ends")
    nameless = every.where("doc_id is null").select("doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("ends"))
    return marked.unionByName(nameless)


def dedup_substrings(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (what is left, binary) of every row; with ``digest``, kept_sha256 for kept.

    Texts are UTF-8 bytes; null is empty; texts of fewer than SPAN bytes lose
    nothing. Strings within one text, and in rows of one doc_id, don't count as
    repeated. Rows that repeat doc_id and text are cut alike. A row without doc_id
    loses nothing and takes nothing from others. Only doc_id and text are read.
    """
    spans = removed_spans(docs)
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long"
    return spans.mapInArrow(_digested, f"{columns}, kept_sha256 string") if digest else spans.mapInArrow(_cut_task, f"{columns}, kept binary")
