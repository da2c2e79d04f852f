"""Language-model scoring by prediction by partial matching (PPM).

The model is a byte-context trie of the lower-cased training texts, counted over
the whole corpus: one row for each context of ``ORDER`` bytes and the byte after
it, summed by a shuffle. Shorter contexts are sums of longer ones. A text's code
length is taken symbol by symbol from the longest known context; where that
lacks the symbol an escape (method C: distinct symbols against all) leads to the
next shorter one, in which symbols of the longer one are excluded. As the trie
is fixed while texts are scored, what exclusion leaves of a context is a number
kept with the longer context. Below order 0 all bytes left are equally likely.

No node is left out. What a gram (a context and its symbol) costs depends on the
nodes of all orders under its context, and those from order ``SHORT`` on share the
last ``SHORT`` bytes of the context: so the grams are dealt by these bytes and each
is worked out where all its nodes are, next to the shorter orders, which have at
most 255 and 65,280 nodes. Grams with at least ``LEAST_SHARE`` of the scored bytes
(at most 1 / LEAST_SHARE, at any size of corpus) are broadcast with their figures,
as are tokens with so large a share of the training tokens. All others are joined by
shuffle, counted per text first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import written

#: Bytes of context. With the symbol they are packed into one integer.
ORDER = 4
#: Orders below this one are known to every task.
SHORT = 2
#: Share of the scored bytes (or training tokens) from which a gram (or token) is broadcast.
LEAST_SHARE = 1 / (1 << 20)
#: Bytes that UTF-8 never has: before the first symbol, and the symbol after the last.
BEFORE, END = 0xFE, 0xFF
#: Symbols that can come: all bytes but BEFORE.
SYMBOLS = 255
#: The key of the token that ends each text.
END_TOKEN = np.uint64(0x1D8E4E27C47D124F)
#: Distinct keys that a task counts before it passes them on.
FLUSH = 1 << 21
#: Grams whose figures are worked out at once; those of one short context stay together.
LOG_ROWS = 1 << 19


def byte_grams(raw: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text, end symbols included, its context and itself as one integer; and where each text begins."""
    n = len(offsets) - 1
    padded = np.full(len(raw) + n * (order + 1), BEFORE, np.uint8)
    shift = np.repeat(np.arange(n) * (order + 1) + order, np.diff(offsets))
    padded[np.arange(len(raw)) + shift] = raw
    ends = offsets[1:] + np.arange(1, n + 1) * (order + 1) - 1
    padded[ends] = END
    grams = padded.astype(np.uint64)
    wide = grams.copy()
    for k in range(1, order + 1):
        wide[k:] |= grams[:-k] << np.uint64(8 * k)
    symbol = padded != BEFORE
    return wide[symbol], offsets + np.arange(n + 1)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens and the text of each; the end tokens come last."""
    starts, stops, first = ts.words(raw, offsets, ts.SPACED_WORD)
    n = len(offsets) - 1
    hashes = np.concatenate((ts.span_hashes(ts.prefix_hashes(raw), starts, stops), np.full(n, END_TOKEN)))
    return hashes, np.concatenate((ts.owners(first), np.arange(n)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))
    return values[at], np.diff(np.concatenate((at, [len(values)])))


def _count_task(order: int, kinds: tuple[int, ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {kind: [] for kind in kinds}

        def out(kind: int) -> pa.RecordBatch:
            keys, counts = _merged(held[kind])
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["kind", "key", "n"])

        for piece in ts.pieces(batches):
            raw, offsets = ts.flat(piece.column("text"))
            raw = ts.LOWER[raw]
            for kind in kinds:
                values = byte_grams(raw, offsets, order)[0] if kind else tokens(raw, offsets)[0]
                held[kind].append(_counted(values))
                if sum(len(k) for k, _ in held[kind]) > FLUSH:
                    held[kind] = [_merged(held[kind])]
                    if len(held[kind][0][0]) > FLUSH // 2:
                        yield out(kind)
        for kind in held:
            if held[kind]:
                yield out(kind)

    return count


def corpus_counts(docs: DataFrame, order: int = ORDER, kinds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(kind, key, n) over all texts: tokens (kind 0) and contexts with their symbol (kind 1)."""
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_task(order, kinds), "kind int, key long, n long")
    return written(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts")


class Table:
    """Integers to numbers by open addressing, many at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values, self.full = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits), np.zeros(1 << bits, bool)
        self.probes = 0
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            self.probes += 1
            free = ~self.full[slot[rest]]
            _, one = np.unique(slot[rest][free], return_index=True)
            new = rest[free][one]
            self.keys[slot[new]], self.values[slot[new]], self.full[slot[new]] = keys[new], values[new], True
            left = np.ones(len(keys), bool)
            left[new] = False
            rest = rest[left[rest]]
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, and which keys are there."""
        slot = self._slot(keys)
        there = (self.keys[slot] == keys) & self.full[slot]
        values = self.values[slot]
        rest = np.flatnonzero(~there & self.full[slot])
        for _ in range(1, self.probes):
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & self.mask
            at = slot[rest]
            hit = self.full[at] & (self.keys[at] == keys[rest])
            values[rest[hit]], there[rest[hit]] = self.values[at[hit]], True
            rest = rest[~hit & self.full[at]]
        return values, there


def _find(keys: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(probe), np.int64), np.zeros(len(probe), bool)
    at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
    return at, keys[at] == probe


class Trie:
    """The nodes of each order, sorted, with what escapes and exclusion need.

    Orders may hold only the nodes under some contexts, if they hold all of these.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], table: bool = True) -> None:
        self.levels = levels
        self.contexts, self.total, self.distinct, self.left_total, self.left_distinct = [], [], [], [], []
        for o, (keys, counts) in enumerate(levels):
            contexts, at = np.unique(keys >> np.uint64(8), return_index=True)
            total = np.add.reduceat(counts, at) if len(at) else np.zeros(0)
            distinct = np.diff(np.concatenate((at, [len(keys)])))
            self.contexts.append(contexts)
            self.total.append(total.astype(float))
            self.distinct.append(distinct.astype(float))
            if o:
                # the shorter context, without the symbols of this one
                above, there = _find(levels[o - 1][0], keys & self._mask(o))
                parent, _ = _find(self.contexts[o - 1], contexts & self._mask(o - 1))
                seen = np.add.reduceat(np.where(there, levels[o - 1][1][above], 0), at) if len(at) else np.zeros(0)
                self.left_total.append(self.total[o - 1][parent] - seen if len(at) else np.zeros(0))
                self.left_distinct.append(self.distinct[o - 1][parent] - distinct if len(at) else np.zeros(0))
            else:
                self.left_total.append(np.zeros(len(contexts)))
                self.left_distinct.append(np.maximum(SYMBOLS - distinct, 1).astype(float))
        keys = levels[-1][0]
        self.table = Table(keys, self._slow(keys)) if table and len(keys) else None

    @staticmethod
    def _mask(n_bytes: int) -> np.uint64:
        return np.uint64((1 << (8 * n_bytes)) - 1)

    def _slow(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context."""
        out, done, on = np.zeros(len(grams)), np.zeros(len(grams), bool), np.zeros(len(grams), bool)
        longer = np.zeros(len(grams), np.int64)
        for o in range(len(self.levels) - 1, -1, -1):
            keys, counts = self.levels[o]
            context, known = _find(self.contexts[o], (grams >> np.uint64(8)) & self._mask(o))
            go = known & ~done
            node, here = _find(keys, grams & self._mask(o + 1))
            if not len(keys):
                continue
            if o + 1 < len(self.levels) and len(self.left_total[o + 1]):
                from_longer = on & ~done
                longer = np.where(from_longer, longer, 0)
                total = np.where(from_longer, self.left_total[o + 1][longer], self.total[o][context])
                distinct = np.where(from_longer, self.left_distinct[o + 1][longer], self.distinct[o][context])
            else:
                total, distinct = self.total[o][context], self.distinct[o][context]
            whole = total + distinct
            hit = go & here
            out[hit] += np.log10(counts[node[hit]] / whole[hit])
            done |= hit
            miss = go & ~here & (distinct > 0)
            out[miss] += np.log10(distinct[miss] / whole[miss])
            longer = np.where(go, context, longer)
            on |= go
        left = self.left_distinct[0][0] if len(self.left_distinct[0]) else float(SYMBOLS)
        out[~done] -= np.log10(left)
        return out

    def log10(self, grams: np.ndarray) -> np.ndarray:
        if self.table is None:
            return self._slow(grams)
        values, there = self.table.get(grams)
        rest = np.flatnonzero(~there)
        if len(rest):
            unique, inverse = np.unique(grams[rest], return_inverse=True)
            values[rest] = self._slow(unique)[inverse]
        return values


def _level(keys: np.ndarray, counts: np.ndarray, order: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of an order, from grams that are at least as long."""
    if not len(keys):
        return keys, counts
    keys, counts = _merged([(keys & Trie._mask(order + 1), counts)])
    return keys[counts >= least], counts[counts >= least]


def _log_task(short, order: int, least: float):
    """From (key, n, m) in order of their short contexts: (key, m, log10) of the grams with m > 0."""

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = short.value
        shared = Trie._mask(len(levels))

        def out(keys: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            learned, wanted = n > 0, m > 0
            longer = [_level(keys[learned], n[learned], o, least) for o in range(len(levels), order + 1)]
            figures = Trie([*levels, *longer], table=False).log10(keys[wanted])
            return pa.RecordBatch.from_arrays([pa.array(keys[wanted].view(np.int64)), pa.array(m[wanted]), pa.array(figures)], names=["key", "m", "log"])

        held, size, bound = [], 0, LOG_ROWS
        for batch in batches:
            held.append((batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy(), batch.column("m").to_numpy()))
            size += batch.num_rows
            if size < bound:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            context = (columns[0] >> np.uint64(8)) & shared
            # the last context may go on in the next batch
            at = int(np.argmax(context == context[-1]))
            if at:
                yield out(*(c[:at] for c in columns))
            held, size = [tuple(c[at:] for c in columns)], len(context) - at
            bound = max(LOG_ROWS, 2 * size)
        if size:
            yield out(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return logs


def gram_logs(leaves: DataFrame, wanted: DataFrame, order: int = ORDER, least_share: float = 0.0) -> DataFrame:
    """(key, m, log): the log10 probability of each gram of ``wanted`` (key, m) under the trie of ``leaves`` (key, n)."""
    spark = leaves.sparkSession
    low = min(SHORT, order)
    shortest = leaves.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * low)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    keys, n = shortest.column("key").to_numpy().astype(np.uint64), shortest.column("n").to_numpy().astype(np.int64)
    least = max(1.0, int(n.sum()) * least_share)
    short = spark.sparkContext.broadcast([_level(keys, n, o, least) for o in range(low)])
    none = F.lit(0).cast("long")
    grams = leaves.select("key", "n", none.alias("m")).unionByName(wanted.select("key", none.alias("n"), "m"))
    grams = grams.groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    grams = grams.withColumn("context", F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * low)) - 1)))
    grams = grams.repartition("context").sortWithinPartitions("context").select("key", "n", "m")
    return written(grams.mapInArrow(_log_task(short, order, least), "key long, m long, log double"), "ppm-logs")


def _score_task(model):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot_keys, hot_logs, order = model.value
        for piece in ts.pieces(batches):
            raw, offsets = ts.flat(piece.column("text"))
            raw = ts.LOWER[raw]
            n = piece.num_rows
            grams, at = byte_grams(raw, offsets, order)
            values, there = table.get(grams)
            score = np.add.reduceat(np.where(there, values, 0.0), at[:-1]) if n else np.zeros(0)
            hashes, owner = tokens(raw, offsets)
            where, hot = _find(hot_keys, hashes)
            logs = np.bincount(owner[hot], hot_logs[where[hot]], minlength=n)
            arrays = [piece.column("doc_id"), piece.column("row"), pa.array(np.bincount(owner, minlength=n)), pa.array(np.bincount(owner[hot], minlength=n)), pa.array(logs.astype(float)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "n_tokens", "n_known", "logs", "score"])

    return scores


def _rare_task(model):
    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot_keys, _, order = model.value
        for piece in ts.pieces(batches):
            raw, offsets = ts.flat(piece.column("text"))
            raw = ts.LOWER[raw]
            hashes, owner = tokens(raw, offsets)
            cold = ~_find(hot_keys, hashes)[1]
            grams, first = byte_grams(raw, offsets, order)
            unknown = ~table.get(grams)[1]
            for kind, keys, of in ((0, hashes[cold], owner[cold]), (1, grams[unknown], ts.owners(first)[unknown])):
                by = np.lexsort((keys, of))
                keys, of = keys[by], of[by]
                at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))))
                times = np.diff(np.concatenate((at, [len(keys)])))
                arrays = [pa.array(np.full(len(at), kind, np.int32)), pa.array(keys[at].view(np.int64)), piece.column("row").take(pa.array(of[at])), pa.array(times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["kind", "key", "row", "times"])

    return rare


def score(docs: DataFrame, training: DataFrame | None = None, order: int = ORDER, least_share: float = 0.0, hot_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``training`` is learned from (``docs`` where None). base_score is the sum of
    log10((c + 1) / (N + V + 1)) over the tokens; score is the log10 probability of
    the lower-cased bytes and the end of the text under the trie. Null and empty texts
    are the end alone. Rows alike in doc_id and text each get their row, with the
    same figures. An empty training table leaves all bytes equally likely.
    ``hot_share`` decides what is broadcast and has no effect on the figures. For a
    coarser model nodes with less than ``least_share`` of the training bytes are left out; by default none is.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = corpus_counts(docs if training is None else training, order)
    leaves = counts.where("kind = 1").select("key", "n")
    wanted = counts if training is None else corpus_counts(docs, order, (1,))
    grams = gram_logs(leaves, wanted.where("kind = 1").select("key", F.col("n").alias("m")), order, least_share)
    most = grams.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    hot_grams = F.col("m") >= max(1.0, most * hot_share)
    words = counts.where("kind = 0").select("key", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    hot_words = F.col("n") >= max(1.0, n * hot_share)
    # at most 1 / hot_share tokens, and as many grams, have so large a share
    hot = words.where(hot_words).toArrow()
    keys = hot.column("key").to_numpy().view(np.uint64)
    by = np.argsort(keys)
    known = grams.where(hot_grams).select("key", "log").toArrow()
    table = Table(known.column("key").to_numpy().view(np.uint64), known.column("log").to_numpy())
    model = spark.sparkContext.broadcast((table, keys[by], np.log10(hot.column("n").to_numpy()[by] + 1.0), order))
    # a row is known by its id and text; what copies of a row add up to is shared among them
    rows = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    each = rows.mapInArrow(_score_task(model), "doc_id long, row long, n_tokens long, n_known long, logs double, score double")
    pairs = rows.select("row", "text").mapInArrow(_rare_task(model), "kind int, key long, row long, times int")
    rest = words.where(~hot_words).select(F.lit(0).alias("kind"), "key", F.log10(F.col("n") + 1.0).alias("log"))
    rest = rest.unionByName(grams.where(~hot_grams).select(F.lit(1).alias("kind"), "key", "log"))
    met = pairs.join(rest, ["kind", "key"])
    word, cost = F.col("kind") == 0, F.col("times") * F.col("log")
    sums = met.groupBy("row").agg(F.sum(F.when(word, F.col("times"))).alias("more_known"), F.sum(F.when(word, cost)).alias("more_logs"), F.sum(F.when(~word, cost)).alias("more_score"))
    copies = F.count(F.lit(1)).over(Window.partitionBy("row"))
    joined = each.join(sums, "row", "left").withColumn("copies", copies)
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.expr("more_known div copies"), F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce(F.col("more_logs") / F.col("copies"), F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("more_score") / F.col("copies"), F.lit(0.0))).alias("score"),
    )
