"""Chroma fingerprints of recordings, and their alignment.

A recording is cut into frames; the spectrum of each is folded into twelve pitch
classes, normed and rounded to whole numbers. Sixteen filters compare sums over
rectangles of this image of pitch classes over time, which an integral image gives
with four look-ups each; every comparison is two bits, and the bits of a window of
frames are one packed integer, the code of the window.

Alignment does not compare all pairs. Winnowing keeps the codes with the least hash
in each run of ``MARK_WINDOW`` codes as marks, so a shared run leaves the same marks in
both recordings. Each mark of a recording votes for all recordings that
have it, and for the offset between the two. All offsets at which enough of the recording
lies over the other are looked at where ``VOTES`` of its marks (one at least) are found there; an offset is a link if the codes that lie over
each other differ in few bits. Of recordings with equal codes one stands for all. Linked recordings form a class.

The recordings are cut into shares of bounded size, and each two shares are a cell, which one task compares; no codes are shuffled. The pairs
that are looked at are quadratic in the recordings of a mark; none is left out. A cell gives of each recording in it how many links it has, the best
of them and the least recording that they lead to, so what leaves the cells doesn't grow with the pairs. ``alignments`` lists every link.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .jaccard_join import components
from .shared import written

#: Codes in a row of which one is a mark at least.
MARK_WINDOW = 8
#: Shares at least into which recordings are dealt where they are large enough; share of a recording's marks that an offset needs.
LEADS, VOTES = 8, 0.05
#: Least share of a recording's codes that lie over the other, and largest share of bits in which they differ.
OVERLAP, BIT_ERRORS = 0.5, 0.15
#: Recordings whose names may be broadcast; beyond it all codes are shuffled.
BROADCAST_ROWS = 500_000
#: Shares that meet all others in one job; rows (no more than 2^15, for the keys of ``_candidates``) and bytes of a share, before it is compressed; pairs that a task lists at once.
ROUND, CELL_ROWS, CELL_BYTES, PAIRS = 64, 1 << 15, 6 << 20, 1 << 18
#: Bytes below which a share is not cut for more tasks.
SMALL_BYTES = 1 << 16
#: Samples that a task turns into spectra, and codes that it compares, at once.
BLOCK_SAMPLES = 1 << 20
#: Levels of a pitch class in a frame.
LEVELS = 255
CLASSES = 12


@dataclass(frozen=True)
class Settings:
    """Samples a second, samples of a frame and from one to the next, the tones that count (Hz), and the frames of a code."""

    rate: int = 11025
    frame: int = 4096
    hop: int = 1365
    low: float = 28.0
    high: float = 3520.0
    window: int = 16


class Pcm:
    """Recordings as one row of samples, which are read a stretch at a time."""

    def __init__(self, samples: np.ndarray, offsets: np.ndarray) -> None:
        self.samples, self.offsets = samples, offsets

    def read(self, start: int, stop: int) -> np.ndarray:
        return self.samples[start:stop]


def pcm8(raw: np.ndarray, offsets: np.ndarray) -> Pcm:
    """Bytes as unsigned 8-bit samples."""
    return Pcm(raw.view(np.int8) ^ np.int8(-128), offsets)


def wav(raw: np.ndarray, offsets: np.ndarray) -> Pcm:
    """WAV files of 8 or 16 bits; channels are averaged. What is no such file is silence without a sample."""
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        try:
            with wave.open(io.BytesIO(raw[a:b].tobytes())) as f:
                width, channels = f.getsampwidth(), f.getnchannels()
                data = f.readframes(f.getnframes())
        except (wave.Error, EOFError):
            width, channels, data = 2, 1, b""
        kind = {1: np.uint8, 2: np.dtype("<i2")}.get(width)
        flat = np.frombuffer(data, kind).astype(np.int32) if kind else np.zeros(0, np.int32)
        out.append((flat[: len(flat) // channels * channels].reshape(-1, channels).mean(1, dtype=np.float32) if len(flat) >= channels else np.zeros(0, np.float32)) - np.float32(128 if width == 1 else 0))
    return Pcm(np.concatenate([*out, np.zeros(0, np.float32)]), np.cumsum([0, *map(len, out)]))


class Melody:
    """Texts as scores: each phrase sounds all pitch classes of an octave for one frame, as loud as its hash says.

    A phrase ends at a word whose hash is divisible by ``every``, so a changed word changes one phrase or two.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, settings: Settings, every: int = 4) -> None:
        raw = ts.LOWER[raw]
        starts, ends, first = ts.words(raw, offsets, ts.ALNUM_WORD)
        hashes = ts.span_hashes(ts.prefix_hashes(raw), starts, ends)
        owner = ts.owners(first)
        last = hashes % np.uint64(every) == 0
        last[first[1:][np.diff(first) > 0] - 1] = True
        at = np.flatnonzero(last)
        begin = np.concatenate(([0], at[:-1] + 1)) if len(at) else at
        place = np.arange(len(hashes)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(hashes)])))) if len(at) else at
        words = ts.mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.phrases = ts.mix(np.add.reduceat(words, begin)) if len(at) else np.zeros(0, np.uint64)
        self.size = settings.frame
        self.offsets = np.searchsorted(owner[at], np.arange(len(offsets))) * self.size
        pitch = settings.low * 2.0 ** (np.arange(CLASSES) / CLASSES)
        self.tones = np.sin(2 * np.pi * pitch[:, None] * np.arange(self.size)[None, :] / settings.rate).astype(np.float32)

    def read(self, start: int, stop: int) -> np.ndarray:
        a, b = start // self.size, -(-stop // self.size)
        loud = (self.phrases[a:b, None] >> (np.arange(CLASSES, dtype=np.uint64) * np.uint64(5))) & np.uint64(31)
        return ((loud.astype(np.float32) ** 2) @ self.tones).ravel()[start - a * self.size : stop - a * self.size]


#: How texts are played: one octave, in which neighbouring pitch classes lie in spectral lines of their own.
MELODY = Settings(rate=4000, frame=128, hop=128, low=880.0, high=1661.3, window=4)


def melody(raw: np.ndarray, offsets: np.ndarray) -> Melody:
    """Texts as scores, for ``MELODY``."""
    return Melody(raw, offsets, MELODY)


def chroma(sound, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pitch classes of all frames, in whole numbers, and where each recording's frames begin.

    A recording shorter than a frame is one frame, filled up with silence; one without samples has none.
    """
    sizes = np.diff(sound.offsets)
    count = np.where(sizes > 0, 1 + np.maximum(sizes - settings.frame, 0) // settings.hop, 0)
    first = np.concatenate(([0], np.cumsum(count)))
    starts = np.repeat(sound.offsets[:-1], count) + (np.arange(first[-1]) - np.repeat(first[:-1], count)) * settings.hop
    ends = np.repeat(sound.offsets[1:], count)
    tone = np.fft.rfftfreq(settings.frame, 1 / settings.rate)
    # half a tone step beyond either end still rounds to the tones at the ends
    heard = np.flatnonzero((tone >= settings.low * 2 ** (-0.5 / CLASSES)) & (tone <= settings.high * 2 ** (0.5 / CLASSES)))
    folded = np.zeros((len(heard), CLASSES))
    folded[np.arange(len(heard)), np.round(CLASSES * np.log2(tone[heard] / 440.0)).astype(int) % CLASSES] = 1
    folded, shape = folded.astype(np.float32), np.hanning(settings.frame).astype(np.float32)
    out = np.zeros((first[-1], CLASSES), np.int64)
    block = max(1, BLOCK_SAMPLES // settings.frame)
    for a in range(0, len(starts), block):
        own, end = starts[a : a + block], ends[a : a + block]
        stop = int(own[-1]) + settings.frame
        samples = sound.read(int(own[0]), min(stop, int(sound.offsets[-1]))).astype(np.float32)
        samples = np.concatenate((samples, np.zeros(stop - int(own[0]) - len(samples), np.float32)))
        frames = np.lib.stride_tricks.sliding_window_view(samples, settings.frame)[own - own[0]]
        for i in np.flatnonzero(own + settings.frame > end):
            frames[i, end[i] - own[i] :] = 0
        spectrum = np.fft.rfft(frames * shape, axis=1)[:, heard[0] : heard[-1] + 1]
        energy = (spectrum.real**2 + spectrum.imag**2) @ folded
        norm = np.sqrt((energy**2).sum(1, keepdims=True))
        out[a : a + block] = np.round(LEVELS * np.divide(energy, norm, out=np.zeros_like(energy), where=norm > 1e-9))
    return out, first


def filters(window: int) -> list[tuple[int, int, int, int, int]]:
    """(kind, first frame, frames, lowest class, classes) of the sixteen filters, by rule.

    Kinds: early against late, low against high, one diagonal against the other, the middle against both sides.
    """
    out = []
    for i in range(16):
        height = (4, 6, 8, 12)[(i // 4 + i) % 4]
        width = window if i % 8 < 4 else max(2, window // 2)
        out.append((i % 4, (i // 8) * (window - width), width, (5 * i) % (CLASSES - height + 1), height))
    return out


#: A comparison counts as clear when one side is so many times the other.
CLEAR = 1.25


def codes(image: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed integers of all windows, and where each recording's begin; one with too few frames is filled up with silence."""
    count = np.diff(first)
    padded = np.where(count > 0, np.maximum(count, window), 0)
    begin = np.concatenate(([0], np.cumsum(padded)))
    flat = np.zeros((begin[-1], CLASSES), np.int64)
    flat[np.arange(len(image)) + np.repeat(begin[:-1] - first[:-1], count)] = image
    integral = np.zeros((begin[-1] + 1, CLASSES + 1), np.int64)
    integral[1:, 1:] = flat.cumsum(0).cumsum(1)
    number = np.where(padded > 0, padded - window + 1, 0)
    n = max(0, len(flat) - window + 1)

    def box(t: int, width: int, low: int, height: int) -> np.ndarray:
        """Sums over a rectangle, for windows that begin at any frame."""
        column = integral[:, low + height] - integral[:, low]
        return column[t + width : t + width + n] - column[t : t + n]

    out = np.zeros(n, np.uint32)
    for kind, t, width, low, height in filters(window):
        whole, w, h = box(t, width, low, height), width // 2, height // 2
        if kind == 0:
            one = box(t, w, low, height)
        elif kind == 1:
            one = box(t, width, low, h)
        elif kind == 2:
            one = box(t, w, low, h) + box(t + w, width - w, low + h, height - h)
        else:
            one = box(t, width, low + height // 4, h)
        one, other = one + 1.0, whole - one + 1.0
        level = (one * CLEAR > other).astype(np.uint32) + (one > other) + (one > other * CLEAR)
        # neighbouring levels differ in one bit
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    starts = np.concatenate(([0], np.cumsum(number)))
    inside = np.arange(starts[-1]) + np.repeat(begin[:-1] - starts[:-1], number)
    return out[inside], starts


def marks(packed: np.ndarray, first: np.ndarray, window: int = MARK_WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Recording and place of each mark: the least hash of every run, the leftmost of equal ones; of equal codes in a recording the first."""
    none = np.zeros(0, np.int64)
    size = np.diff(first)
    if not len(packed):
        return none, none
    at = np.arange(len(packed))
    key = (ts.mix(packed.astype(np.uint64)) & np.uint64(0xFFFFFFFF << 32)) | at.astype(np.uint64)
    some = np.flatnonzero(size > 0)
    kept = [np.minimum.reduceat(key, first[some])[size[some] <= window]]
    least, width = key, 1
    while width < window and len(least) > width:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    if width == window:
        kept.append(least[(at + window <= np.repeat(first[1:], size))[: len(least)]])
    place = np.unique(np.concatenate(kept) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    of = np.searchsorted(first, place, side="right") - 1
    order = np.lexsort((place, packed[place], of))
    new = np.ones(len(order), bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (packed[place[order]][1:] != packed[place[order]][:-1])
    take = np.sort(order[new])
    return of[take], place[take] - first[of[take]]


def _print_task(decode: Callable, settings: Settings):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in ts.pieces(batches, "media"):
            raw, offsets = ts.flat(piece.column("media"))
            image, first = chroma(decode(raw, offsets), settings)
            packed, begin = codes(image, first, settings.window)
            of, place = marks(packed, begin)
            at = pa.array(np.searchsorted(of, np.arange(piece.num_rows + 1)).astype(np.int32))
            code = packed[begin[of] + place].view(np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (code, place.astype(np.int32))]
            blobs = pa.array([packed[a:b].astype("<u4").tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(first)), blobs, *lists], names=["doc_id", "n_frames", "codes", "marks", "places"])

    return prints


def fingerprints(recordings: DataFrame, decode: Callable = wav, settings: Settings = Settings(), media: str = "media") -> DataFrame:
    """doc_id, n_frames, codes (4 bytes each, little-endian), marks and places of every row.

    ``decode`` turns the bytes (or texts) of many recordings, laid end to end, and their
    offsets into sounds: ``wav``, ``pcm8``, or another callable that gives ``offsets`` in
    samples and ``read``. Null and empty media, and WAV files that cannot be read, have no
    frames and no codes. A recording that is shorter than a frame, or than the window of a
    code, is filled up with silence to one. Only doc_id and ``media`` are read.
    """
    kind = "binary" if dict(recordings.dtypes)[media] == "binary" else "string"
    rows = recordings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(media).cast(kind).alias("media"))
    return rows.mapInArrow(_print_task(decode, settings), "doc_id long, n_frames long, codes binary, marks array<int>, places array<int>")


def bit_errors(one: bytes, other: bytes, offset: int) -> tuple[int, int]:
    """Codes of ``other`` that lie over ``one`` when it begins ``offset`` codes later in ``one``, and the bits in which they differ."""
    a, b = np.frombuffer(one, "<u4"), np.frombuffer(other, "<u4")
    low, high = max(0, -offset), min(len(b), len(a) - offset)
    if high <= low:
        return 0, 0
    return high - low, int(np.bitwise_count(a[low + offset : high + offset] ^ b[low:high]).sum())


class _Codes:
    """Codes of a batch's recordings, end to end, and which of them are marks."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        raw, at = ts.flat(rows.column("codes"))
        self.flat, self.first = raw.view("<u4"), at // 4
        self.size = np.diff(self.first)
        places = rows.column("places")
        self.n_marks = np.diff(places.offsets.to_numpy()).astype(np.int64)
        self.of = np.repeat(np.arange(rows.num_rows), self.n_marks)
        self.place = places.flatten().to_numpy().astype(np.int64)
        self.mark = self.flat[self.first[self.of] + self.place]
        self.id, self.tag = rows.column("id").to_numpy(), rows.column("tag").to_numpy()
        self.named = rows.column("named").to_numpy(zero_copy_only=False)


def _candidates(codes: _Codes, split: int, at_once: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of recordings at each offset at which they have a common mark, with the number of these: those before ``split`` with those from there on, or
    (``split`` 0) all with all. All that a recording of the one side has comes at once, some ``at_once`` common marks at a time."""
    n, end = len(codes.size), int(np.searchsorted(codes.of, split)) if split else len(codes.of)
    right = np.arange(end if split else 0, len(codes.of))
    right = right[np.argsort(codes.mark[right], kind="stable")]
    sought = np.argsort(codes.mark[:end], kind="stable")
    low, high = np.zeros(end, np.int64), np.zeros(end, np.int64)
    low[sought] = np.searchsorted(codes.mark[right], codes.mark[sought])
    high[sought] = np.searchsorted(codes.mark[right], codes.mark[sought], side="right")
    before = np.concatenate(([0], np.cumsum(high - low)))
    begin = np.searchsorted(codes.of[:end], np.arange((split or n) + 1))
    block = before[begin[1:]] // at_once
    shift = int(codes.size.max(initial=0))
    span = 2 * shift + 1
    for a, b in zip(cuts := [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)], cuts[1:], strict=False):
        own = np.arange(begin[a], begin[b])
        count = high[own] - low[own]
        one = np.repeat(own, count)
        two = right[np.arange(len(one)) + np.repeat(low[own] - (np.cumsum(count) - count), count)]
        if not split:
            later = codes.of[one] < codes.of[two]
            one, two = one[later], two[later]
        if not len(one):
            continue
        key = ((codes.of[one] - a) * n + codes.of[two]) * span + (codes.place[one] - codes.place[two] + shift)
        key.sort()
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        pair, offset = np.divmod(key[new], span)
        yield pair // n + a, pair % n, offset - shift, np.diff(np.append(new, len(key)))


def _bit_errors(codes: _Codes, own: np.ndarray, lead: np.ndarray, offset: np.ndarray, over: np.ndarray) -> np.ndarray:
    """The bits in which pairs of recordings differ where they lie over each other, a block of codes at a time."""
    low, errors = np.maximum(0, -offset), np.zeros(len(own), np.int64)
    block = np.cumsum(over) // BLOCK_SAMPLES
    for at in np.split(np.arange(len(own)), np.flatnonzero(np.diff(block)) + 1) if len(own) else ():
        n = over[at]
        begin = np.cumsum(n) - n
        mine = np.arange(int(n.sum())) + np.repeat(codes.first[own[at]] + low[at] - begin, n)
        theirs = mine + np.repeat(codes.first[lead[at]] + offset[at] - codes.first[own[at]], n)
        errors[at] = np.add.reduceat(np.bitwise_count(codes.flat[mine] ^ codes.flat[theirs]), begin, dtype=np.int64)
    return errors


def _least(rows: list[np.ndarray], by: tuple[np.ndarray, ...], group: np.ndarray) -> list[np.ndarray]:
    """The row of each group that comes first in the order ``by``."""
    order = np.lexsort((*reversed(by), group))
    return [x[order[np.concatenate(([True], np.diff(group[order]) != 0))]] if len(order) else x for x in rows]


def _links(codes: _Codes, split: int, at_once: int) -> Iterator[list[np.ndarray]]:
    """Recording, earlier one, offset, codes that lie over each other and wrong bits of links, one for a pair: that with the smallest share of wrong bits."""
    for one, two, offset, votes in _candidates(codes, split, at_once):
        # the later one, or the one without a name, is laid over the other
        x, y, named = codes.id[one], codes.id[two], codes.named
        turn = np.where(named[one] & named[two], (x > y) | ((x == y) & (codes.tag[one] > codes.tag[two])), named[two])
        own, lead, offset = np.where(turn, one, two), np.where(turn, two, one), np.where(turn, -offset, offset)
        over = np.minimum(codes.size[own], codes.size[lead] - offset) - np.maximum(0, -offset)
        need = np.maximum(np.ceil(codes.n_marks[own] * VOTES), 1)
        take = np.flatnonzero(named[lead] & (votes >= need) & (over > 0) & (over >= OVERLAP * codes.size[own]))
        own, lead, offset, over = own[take], lead[take], offset[take], over[take]
        errors = _bit_errors(codes, own, lead, offset, over)
        rows = [c[errors <= 32 * BIT_ERRORS * over] for c in (own, lead, offset, over, errors)]
        own, lead, offset, over, errors = rows
        yield _least(rows, (errors / over, np.abs(offset), offset), own * len(codes.size) + lead)


_LINK = "id long, tag int, lead_id long, lead_tag int, offset int, n_over long, n_errors long"
_REACHED = "id long, tag int, root_id long, root_tag int, n_links long, lead_id long, offset int, n_over long, n_errors long"


def _listed(codes: _Codes, links: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Every link of a cell."""
    for own, lead, offset, over, errors in links:
        columns = [codes.id[own], codes.tag[own], codes.id[lead], codes.tag[lead], offset.astype(np.int32), over, errors]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "tag", "lead_id", "lead_tag", "offset", "n_over", "n_errors"])


def _together(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each leads to, with links between ``a`` and ``b`` besides."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
        a, b = a[apart], b[apart]


def _reached(codes: _Codes, links: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A row for each recording of a cell that has links there, or is the earlier one of some: their number, the best of them, and the least one in reach."""
    n = len(codes.size)
    # an earlier one has a name, so the least one in reach has
    order = np.lexsort((codes.tag, codes.id, ~codes.named))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    root, n_links, led = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
    best = [np.zeros(0, np.int64)] * 5
    for rows in links:
        own, lead = rows[:2]
        root = _together(root, rank[own], rank[lead])
        n_links += np.bincount(own, minlength=n)
        led[lead] = True
        best = [np.concatenate(c) for c in zip(best, rows, strict=True)]
        best = _least(best, (best[4] / best[3], codes.id[best[1]], best[2], best[3]), best[0])
    least = order[root[rank]]
    at = np.flatnonzero((n_links > 0) | (led & (least != np.arange(n))))
    if len(at):
        none = n_links[at] == 0
        figures = np.zeros((4, n), np.int64)
        figures[:, best[0]] = codes.id[best[1]], *best[2:]
        ends = [codes.id[at], codes.tag[at], codes.id[least[at]], codes.tag[least[at]], n_links[at]]
        figures = [pa.array(c[at].astype(kind), mask=none) for c, kind in zip(figures, (np.int64, np.int32, np.int64, np.int64), strict=True)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, ends), *figures], names=["id", "tag", "root_id", "root_tag", "n_links", "lead_id", "offset", "n_over", "n_errors"])


def _share_task(most_rows: int, most_bytes: int):
    """Recordings to shares, each of them one value; a share is full with the row that fills it."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["recordings"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in batches:
            sizes = [np.diff(batch.column(c).offsets.to_numpy()) if c == "places" else pc.binary_length(batch.column(c)).to_numpy() for c in ("codes", "places")]
            ends = np.concatenate(([0], np.cumsum(sizes[0] + 4 * sizes[1], dtype=np.int64)))
            at = 0
            while at < batch.num_rows:
                stop = min(at + most_rows - n, max(at + 1, int(np.searchsorted(ends, ends[at] + most_bytes - size))), batch.num_rows)
                held.append(batch.slice(at, stop - at))
                n, size, at = n + stop - at, size + int(ends[stop] - ends[at]), stop
                if n >= most_rows or size >= most_bytes:
                    yield packed(held)
                    held, n, size = [], 0, 0
        if held:
            yield packed(held)

    return shares


def _cell_task(listed: bool, at_once: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, x, y in zip(*(batch.column(c) for c in ("one", "two", "x", "y")), strict=True):
                sides = [pa.ipc.open_stream(side.as_buffer()).read_all() for side in ((x,) if one == two else (x, y))]
                codes = _Codes(pa.concat_tables(sides).combine_chunks().to_batches()[0])
                yield from (_listed if listed else _reached)(codes, _links(codes, 0 if one == two else sides[0].num_rows, at_once))

    return cells


def _few(names: DataFrame) -> DataFrame:
    """Marked for broadcast where there are few."""
    return F.broadcast(names) if names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else names


def _named(names: DataFrame) -> DataFrame:
    """With id and tag under the names i and t."""
    return names.withColumnsRenamed({"id": "i", "tag": "t"})


def _is() -> Column:
    return (F.col("id") == F.col("i")) & (F.col("tag") == F.col("t"))


def distinct_takes(prints: DataFrame) -> DataFrame:
    """One row of each recording (id, tag), however often it is repeated; ``row`` numbers the rows."""
    several = prints.groupBy("id", "tag").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "tag", "least")
    takes = prints.join(_few(_named(_kept(several, "repeated"))), _is(), "left")
    return takes.where("least is null or row = least").drop("i", "t", "least")


def _kept(df: DataFrame, what: str) -> DataFrame:
    """Written, without what was shuffled for it."""
    return written(df, what, tidy=True)


def alignments(prints: DataFrame) -> DataFrame:
    """(id, tag, lead_id, lead_tag, offset, n_over, n_errors): links of recordings (id, tag, named, codes, places), a row each, to earlier ones.

    A recording is known by ``id`` and ``tag``; only those that are ``named`` can be the earlier one. ``offset`` is
    where the recording begins in the earlier one, in codes. Of recordings with equal codes the first has all links, the others one to the first.
    """
    copies, links = _aligned(prints, listed=True)
    return links.unionByName(copies)


def _aligned(prints: DataFrame, listed: bool) -> tuple[DataFrame, DataFrame]:
    """Links of copies to the first of their codes; and between recordings with different codes either all links, or a row of each recording and cell."""
    copies = _kept(_copies(prints), "chroma-copies")
    takes = prints.where(F.octet_length("codes") > 0).join(_few(_named(copies.select("id", "tag"))), _is(), "left_anti")
    shares = _shares(takes.select("id", "tag", "named", "codes", "places"))
    ids = sorted(r.share for r in shares.select("share").collect())
    kind = _LINK if listed else _REACHED
    found = []
    for k in range(0, max(1, len(ids)), ROUND):
        now = ids[k : k + ROUND]
        one = shares.where(F.col("share").between(now[0], now[-1])) if now else shares
        cells = one.select(F.col("share").alias("one"), F.col("recordings").alias("x")).hint("shuffle_replicate_nl")
        cells = cells.join(shares.select(F.col("share").alias("two"), F.col("recordings").alias("y")), F.col("one") <= F.col("two"))
        # a cell at a time goes to Python
        found.append(written(cells.mapInArrow(_cell_task(listed, PAIRS), kind), "chroma-links", batch_bytes=1))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return copies, links


def _shares(takes: DataFrame) -> DataFrame:
    """(share, recordings): the recordings in shares of bounded size, numbered, each of them one value."""
    rows, n_bytes = takes.agg(F.count(F.lit(1)), F.sum(F.octet_length("codes") + 4 * F.size("places").cast("long"))).first()
    most = min(CELL_BYTES, max(SMALL_BYTES, -(-(n_bytes or 0) // LEADS)))
    n = max(1, -(-(n_bytes or 0) // most), -(-rows // CELL_ROWS))
    packed = takes.coalesce(n).mapInArrow(_share_task(CELL_ROWS, most), "recordings binary")
    return _kept(packed.select(F.monotonically_increasing_id().alias("share"), "recordings"), "chroma-shares")


def _copies(prints: DataFrame) -> DataFrame:
    """Links of recordings to the first with the same codes, the first itself left out."""
    own = prints.where(F.octet_length("codes") > 0).select("id", "tag", "named", F.xxhash64("codes").alias("same"), F.octet_length("codes").alias("size"))
    first = own.groupBy("same", "size").agg(F.min(F.struct((~F.col("named")).alias("unnamed"), "id", "tag")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1 and not f.unnamed")
    both = own.join(first, ["same", "size"]).where((F.col("id") != F.col("f.id")) | (F.col("tag") != F.col("f.tag")))
    return both.select("id", "tag", F.col("f.id").alias("lead_id"), F.col("f.tag").alias("lead_tag"), F.lit(0).alias("offset"), (F.col("size") / 4).cast("long").alias("n_over"), F.lit(0).cast("long").alias("n_errors"))


def align(recordings: DataFrame, decode: Callable = wav, settings: Settings = Settings(), media: str = "media") -> DataFrame:
    """One row per row of ``recordings``: doc_id, n_frames, codes, class_id, n_links, match_id, offset, n_over, n_errors.

    class_id is the smallest doc_id that links lead to, the row's own included; n_links counts the links of the row to
    earlier recordings; one with the codes of an earlier recording has the links of the first of these, and one to it. match_id is the earlier recording that lies over the row's with the smallest
    share of wrong bits (of equal ones the smallest id, then offset), ``offset`` where the row begins in it, in codes, n_over
    the codes that lie over each other, n_errors the bits in which they differ; null without a link. A recording without
    codes is linked with nothing. Repeated rows each get their row and are alike. A null doc_id is never matched by others,
    and is its class where no link leads from it. Two recordings under one doc_id are told apart by their codes. Silence
    and steady tones have one mark, which lies over their beginning.
    """
    prints = fingerprints(recordings, decode, settings, media)
    # of one id, recordings with other codes have other tags; a row without an id is known by its codes
    tag = F.pmod(F.xxhash64("codes"), F.lit(1 << 16)).cast("int")
    named = [F.coalesce("doc_id", F.xxhash64("codes")).alias("id"), tag.alias("tag"), F.col("doc_id").isNotNull().alias("named"), F.monotonically_increasing_id().alias("row")]
    prints = written(prints.select("*", *named).drop("marks"), "chroma-prints")
    copies, links = _aligned(distinct_takes(prints), listed=False)
    figures = F.struct((F.col("n_errors") / F.col("n_over")).alias("share"), "lead_id", "offset", "n_over", "n_errors")
    best = links.where("n_links > 0").groupBy("id", "tag").agg(F.min(figures).alias("b"), F.sum("n_links").alias("n_links"))
    # a copy has the links of the first one, and that to the first one
    firsts = best.select(F.col("id").alias("i"), F.col("tag").alias("t"), F.col("b").alias("first"), F.col("n_links").alias("more"))
    copied = copies.join(firsts, (F.col("lead_id") == F.col("i")) & (F.col("lead_tag") == F.col("t")), "left")
    best = best.unionByName(copied.select("id", "tag", F.least(figures, "first").alias("b"), (1 + F.coalesce("more", F.lit(0))).alias("n_links")))
    ends = links.select("id", "tag", "root_id", "root_tag").unionByName(copies.select("id", "tag", F.col("lead_id").alias("root_id"), F.col("lead_tag").alias("root_tag")))
    best = best.select(F.xxhash64("id", "tag").alias("r"), "n_links", F.col("b.lead_id").alias("match_id"), "b.offset", "b.n_over", "b.n_errors")
    found = components(ends.select(F.xxhash64("id", "tag").alias("a"), F.xxhash64("root_id", "root_tag").alias("b")).distinct())
    # an unnamed recording is never the earlier one, so every class has a named one, and the least of a class is the root of a cell
    named = ends.select(F.xxhash64("root_id", "root_tag").alias("m"), F.col("root_id").alias("named_id")).distinct()
    least = found.join(named, F.col("node") == F.col("m")).groupBy("component").agg(F.min("named_id").alias("class_id"))
    classes = found.join(least, "component").select(F.col("node").alias("r"), "class_id")
    result = written(classes.join(best, "r", "left").withColumnRenamed("r", "k"), "chroma-classes")
    # only what is linked has a row: while these are few, the codes of the others stay where they are
    joined = prints.join(_few(result), F.xxhash64("id", "tag") == F.col("k"), "left")
    return joined.select("doc_id", "n_frames", "codes", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "match_id", "offset", "n_over", "n_errors")
