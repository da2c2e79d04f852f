"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled 1; all documents outside the held
out fold are the unlabelled web text. Text statistics become bins at quantiles
of the whole corpus, and a linear score over the bins minimises the
non-negative unbiased risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),  l(z) = (1 - z)^2 / 4.

With this loss the risk and its gradient depend on the data through the first
and second moments of P and U alone. One distributed pass sums these over every
row; the minimisation then runs on two small matrices, whatever the size of the
corpus. The class prior is estimated from P and U alone, never from negatives: a set of texts
that bad ones do not reach has the share prior * (its share among positives) of U, so
the prior is the least ratio of the two shares. A first guess takes it over the bins of
the statistics; the one that counts takes it over the upper ends of the linear score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import written

#: Score from which a text counts as good.
THRESHOLD = 0.7
#: Bins of each statistic, and the weight of the ridge: a fixed part, and one that shrinks with the positives.
BINS, RIDGE, RIDGE_ROWS = 8, 1e-4, 1.0
#: Bins, and upper ends of the linear score, with a smaller share of the positives don't vote on the class prior.
LEAST_SHARE, LEAST_END = 0.05, 0.25
#: Largest estimate of the class prior.
MOST_PRIOR = 0.95
#: Share of the score that follows the linear score inside a step of the posterior.
WITHIN = 0.02

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "bang", "pipe", "dash", "high", "blank", "line_bytes", "stops",
    "distinct", "repeats", "top", "grams", "bare", "short", "long", "line_ends",
)

_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "symbol": b"#$%&*@^~<>{}[]\\/_=+", "bang": b"!", "pipe": b"|", "dash": b"-", "high": range(128, 256),
    "blank": b" \t\n\x0b\x0c\r", "stops": b".,;:?",
}
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True


def _tables() -> dict[str, np.ndarray]:
    out = {}
    for name, members in _CLASSES.items():
        out[name] = np.zeros(256, bool)
        out[name][list(members)] = True
    return out


_TABLES = _tables()


def _distinct(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners of the distinct hashes of each owner, where they begin in sorted order, and how often they stand; by 40 bits of hash."""
    keys = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    at = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return (keys[at] >> np.uint64(40)).astype(np.int64), at, np.diff(np.concatenate((at, [len(keys)])))


def text_statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text; empty texts have zeros."""
    raw, offsets = ts.flat(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    per_byte = np.maximum(size, 1)
    column: dict[str, np.ndarray] = {"log_bytes": np.log1p(size)}
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    for name, table in _TABLES.items():
        column[name] = total(table[raw]) / per_byte
    ends = total(raw == 10)
    column["line_bytes"] = np.log1p(size / (ends + 1))
    starts, stops, first = ts.words(raw, offsets, ts.SPACED_WORD)
    count = np.diff(first)
    per_word = np.maximum(count, 1)
    column["log_words"] = np.log1p(count)
    column["word_bytes"] = np.diff(np.concatenate(([0], np.cumsum(stops - starts)))[first]) / per_word
    of_words = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[first]) / per_word
    column["short"], column["long"] = of_words(stops - starts <= 2), of_words(stops - starts >= 12)
    if len(starts):
        letters = np.concatenate(([0], np.cumsum(_ALPHA[raw])))
        column["bare"] = of_words(letters[stops] == letters[starts])
        last = raw[stops - 1]
        column["line_ends"] = of_words((last == 46) | (last == 33) | (last == 63))
        hashes = ts.span_hashes(ts.prefix_hashes(ts.LOWER[raw]), starts, stops)
        owner = ts.owners(first)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        column["repeats"] = of_words(same)
        o, new, runs = _distinct(owner, hashes)
        column["distinct"] = np.bincount(o, minlength=n) / per_word
        top = np.zeros(n)
        np.maximum.at(top, o, runs)
        column["top"] = top / per_word
        grams = ts.gram_hashes(hashes, 3)
        whole = owner[: len(grams)] == owner[len(hashes) - len(grams) :]
        o, _, _ = _distinct(owner[: len(grams)][whole], grams[whole])
        column["grams"] = np.bincount(o, minlength=n) / np.maximum(count - 2, 1)
    out = np.zeros((n, len(STATISTICS)), np.float32)
    for k, name in enumerate(STATISTICS):
        if name in column:
            out[:, k] = column[name]
    return out


@dataclass(frozen=True)
class Model:
    """Cut points of each statistic, a weight for each bin, and the posterior at points of the linear score."""

    cuts: tuple[np.ndarray, ...]
    weights: np.ndarray
    grid: np.ndarray
    posterior: np.ndarray
    prior: float

    def linear(self, stats: np.ndarray) -> np.ndarray:
        return _bins(stats, self.cuts) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Posterior of the good class. The posterior is a step function; a share of ``ORDER`` for the linear score keeps the order inside a step."""
        if not len(self.weights):
            return np.full(len(stats), self.prior)
        g = self.linear(stats)
        return np.clip((1 - WITHIN) * np.interp(g, self.grid, self.posterior) + WITHIN / (1 + np.exp(-2 * g)), 0.0, 1.0)


def _bins(stats: np.ndarray, cuts: tuple[np.ndarray, ...]) -> np.ndarray:
    parts = [np.ones((len(stats), 1))]
    for k, cut in enumerate(cuts):
        parts.append(np.eye(len(cut) + 1)[np.searchsorted(cut, stats[:, k], side="right")])
    return np.hstack(parts)


def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in ts.pieces(batches):
        stats = text_statistics(piece.column("text"))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), len(STATISTICS)).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), flat], names=["doc_id", "stats"])


def statistics_of(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row; null texts are empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_stats_rows, "doc_id long, stats array<float>")


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether the CRC-32 of the id as text falls into the held out fold; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _flag(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def _sums_of(totals: np.ndarray) -> pa.RecordBatch:
    which, index = np.nonzero(totals)
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(index, pa.int32()), pa.array(totals[which, index])], names=["which", "i", "v"])


def _moments(cuts):
    """Sums over a task for U and P of each half (0 to 3): the count, the first and the second moments, as (set, index, value)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 + sum(len(c) + 1 for c in cuts)
        second = np.zeros((4, size, size))
        for batch in batches:
            x, positive, half = _bins(_matrix(batch), cuts), _flag(batch, "positive"), _flag(batch, "half")
            for k, take in enumerate((~half, ~half & positive, half, half & positive)):
                second[k] += x[take].T @ x[take]
        yield _sums_of(second.reshape(4, -1))

    return sums


def _minimise(p: np.ndarray, u: np.ndarray, prior: float, ridge: float = RIDGE, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Least non-negative risk from the second moments (the first row has the first moments).

    Where the negative part of the risk is positive at the least unbiased risk, that is the answer; else
    descent that steps back whenever this part goes below zero.
    """
    sp, su = p / p[0, 0], u / u[0, 0]
    mp, mu = sp[0], su[0]
    eye = 2 * ridge * np.eye(len(mp))
    w = np.linalg.solve(su / 2 + eye, prior * mp - mu / 2)
    bad = lambda w: (1 + 2 * w @ mu + w @ su @ w) / 4 - prior * (1 + 2 * w @ mp + w @ sp @ w) / 4
    if bad(w) >= 0:
        return w
    w = np.zeros(len(mp))
    for _ in range(steps):
        negative = (mu + su @ w) / 2 - prior * (mp + sp @ w) / 2
        w -= rate * (prior * (sp @ w - mp) / 2 + negative + eye @ w if bad(w) >= 0 else -negative)
    return w


def _posterior(good: np.ndarray, all_: np.ndarray, prior: float) -> np.ndarray:
    """prior * f_P / f_U by bin of the linear score, made to rise (pool adjacent violators)."""
    share = prior * good / max(good.sum(), 1) * all_.sum()
    blocks: list[list[float]] = []
    for top, below in zip(share, all_, strict=True):
        blocks.append([top, below, 1])
        while len(blocks) > 1 and blocks[-2][0] * max(blocks[-1][1], 1e-9) >= blocks[-1][0] * max(blocks[-2][1], 1e-9):
            t, b, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + b, blocks[-1][2] + n]
    return np.clip(np.concatenate([np.full(int(n), t / max(b, 1e-9)) for t, b, n in blocks]), 0, 1)


def least_ratio(u: np.ndarray, p: np.ndarray, n_u: float, n_p: float, least_share: float = LEAST_SHARE) -> float:
    """The class prior from counts of U and P in some sets of texts: the least ratio of shares.

    The least of many noisy ratios is too small: each gets its deviation first. Above ``MOST_PRIOR`` bad texts
    would be too few to be told from noise.
    """
    voting = p >= max(least_share * n_p, 1)
    ratio = (u[voting] / n_u) / (p[voting] / n_p) * (1 + np.sqrt(1 / p[voting] + 1 / np.maximum(u[voting], 1)))
    return float(ratio.min(initial=MOST_PRIOR))


#: Bins of the linear score, in which the posterior is estimated.
GRID = np.linspace(-3, 3, 241)


def _histogram(halves: tuple[Model, Model]):
    """Counts of U and P by bin of the linear score that the model of the other half gives."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, len(GRID)))
        for batch in batches:
            stats, positive, half = _matrix(batch), _flag(batch, "positive"), _flag(batch, "half")
            for own, model in ((half, halves[0]), (~half, halves[1])):
                at = np.clip(np.searchsorted(GRID, model.linear(stats[own])), 0, len(GRID) - 1)
                n[0] += np.bincount(at, minlength=len(GRID))
                n[1] += np.bincount(at[positive[own]], minlength=len(GRID))
        yield _sums_of(n)

    return counts


def fit(stats: DataFrame, labels: DataFrame, prior: float | None = None, bins: int = BINS, ridge: float = RIDGE) -> Model:
    """The model from (doc_id, stats) of the training rows and their (doc_id, quality).

    All rows are U; those labelled 1 are P as well. A document with labels that
    differ is not trusted, and labels 0 are not used. ``prior`` is the share of good text,
    estimated as the module says where it is None. Without rows or positives every
    text scores the prior (0.5 if None).
    """
    spark = stats.sparkSession
    marked = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    marked = marked.where("quality = 1").select(F.col("doc_id").alias("__id"), F.lit(True).alias("positive"))
    rows = written(stats.join(marked, F.col("doc_id") == F.col("__id"), "left").select("stats", (F.pmod(F.xxhash64("doc_id", "stats"), F.lit(2)) == 1).alias("half"), F.coalesce("positive", F.lit(False)).alias("positive")), "pu-rows")
    q = [i / bins for i in range(1, bins)]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("p"), *[F.percentile_approx(F.col("stats")[k], q, 1000).alias(name) for k, name in enumerate(STATISTICS)]).first()
    if not seen["p"]:
        return Model((), np.zeros(0), GRID, GRID, prior if prior is not None else 0.5)
    cuts = tuple(np.unique(np.array(seen[name], np.float32)) for name in STATISTICS)
    total = lambda make, sets, size: _gather(rows.mapInArrow(make, "which int, i int, v double").groupBy("which", "i").agg(F.sum("v").alias("v")), sets, size)
    size = 1 + sum(len(c) + 1 for c in cuts)
    u0, p0, u1, p1 = total(_moments(cuts), 4, size * size).reshape(4, size, size)
    u, p = u0 + u1, p0 + p1

    def fitted(prior: float) -> tuple[Model, np.ndarray, np.ndarray]:
        """The model, and U and P by bin of the linear score that the weights of the other half give."""
        made = lambda p, u: Model(cuts, _minimise(p, u, prior, ridge + RIDGE_ROWS / p[0, 0]), GRID, GRID, prior)
        whole = made(p, u)
        # measured on texts that the weights have not seen, or the positives would look too good
        halves = (made(p0, u0), made(p1, u1)) if p0[0, 0] and p1[0, 0] else (whole, whole)
        return whole, *total(_histogram(halves), 2, len(GRID))

    if prior is None:
        guess = least_ratio(u[0], p[0], u[0, 0], p[0, 0])
        _, everything, good = fitted(guess)
        upper = lambda n: np.cumsum(n[::-1])
        prior = least_ratio(upper(everything), upper(good), everything.sum(), good.sum(), LEAST_END)
    whole, everything, good = fitted(prior)
    return Model(cuts, whole.weights, GRID, _posterior(good, everything, prior), prior)


def _gather(sums: DataFrame, sets: int, size: int) -> np.ndarray:
    """At most sets * size rows: the sums, whatever the number of documents."""
    out = np.zeros((sets, size))
    for which, i, v in sums.collect():
        out[which, i] = v
    return out


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from (doc_id, stats)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(_matrix(batch)))], names=["doc_id", "score"])

    return stats.mapInArrow(scores, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Labels of held out documents are never read. Null and empty texts are scored
    like any text without words; repeated rows score alike; rows with a null id
    are unlabelled text. Only doc_id, text and quality are read.
    """
    stats = written(statistics_of(docs), "pu-statistics")
    model = fit(stats.where(~held_out()), labels.where(~held_out()), prior)
    scored = score_statistics(stats, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, prior: float | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns kept; fitted on ``docs`` as in ``classify``."""
    model = fit(statistics_of(docs).where(~held_out()), labels.where(~held_out()), prior)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in ts.pieces(batches):
            yield piece.filter(pa.array(shared.value.score(text_statistics(piece.column("text"))) >= threshold))

    return docs.mapInArrow(good, docs.schema)
