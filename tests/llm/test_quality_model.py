"""The quality query against a model by loops over single rows: no moments, no bins of many rows at once."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import pu_quality as Q
from lodestone.llm import queries


def statistics(text):
    b = (text or "").encode()
    size = max(len(b), 1)
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    low = [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in words]
    n = max(len(words), 1)
    share = lambda members: sum(c in members for c in b) / size
    letter = lambda c: 65 <= c < 91 or 97 <= c < 123 or c >= 128
    grams = {tuple(low[i : i + 3]) for i in range(len(low) - 2)}
    return {
        "log_bytes": math.log1p(len(b)), "log_words": math.log1p(len(words)), "word_bytes": sum(map(len, words)) / n, "upper": share(range(65, 91)), "digit": share(range(48, 58)),
        "symbol": share(b"#$%&*@^~<>{}[]\\/_=+"), "bang": share(b"!"), "pipe": share(b"|"), "dash": share(b"-"), "high": share(range(128, 256)), "blank": share(b" \t\n\x0b\x0c\r"),
        "line_bytes": math.log1p(len(b) / (b.count(b"\n") + 1)), "stops": share(b".,;:?"), "distinct": len(set(low)) / n, "repeats": sum(x == y for x, y in zip(low, low[1:])) / n,
        "top": max(Counter(low).values(), default=0) / n, "grams": len(grams) / max(len(words) - 2, 1), "bare": sum(not any(map(letter, w)) for w in words) / n,
        "short": sum(len(w) <= 2 for w in words) / n, "long": sum(len(w) >= 12 for w in words) / n, "line_ends": sum(w[-1:] in (b".", b"!", b"?") for w in words) / n,
    }


def encode(row, cuts):
    """One entry for the constant, and one for the bin of each statistic."""
    x = [1.0]
    for value, cut in zip(row, cuts, strict=True):
        x += [float(sum(c <= value for c in cut) == k) for k in range(len(cut) + 1)]
    return np.array(x)


def least_risk(P, U, prior, ridge):
    """Weights of the least non-negative risk, from single rows."""
    size = len(U[0])
    half = sum(np.outer(x, x) for x in U) / len(U) / 2 + 2 * ridge * np.eye(size)
    w = np.linalg.solve(half, prior * sum(P) / len(P) - sum(U) / len(U) / 2)
    loss = lambda z: (1 - z) ** 2 / 4
    bad = lambda w: sum(loss(-(w @ x)) for x in U) / len(U) - prior * sum(loss(-(w @ x)) for x in P) / len(P)
    if bad(w) >= 0:
        return w
    w = np.zeros(size)
    for _ in range(400):
        negative = sum((1 + w @ x) * x for x in U) / len(U) / 2 - prior * sum((1 + w @ x) * x for x in P) / len(P) / 2
        positive = -prior * sum((1 - w @ x) * x for x in P) / len(P) / 2
        w = w - 0.05 * (positive + negative + 2 * ridge * w if bad(w) >= 0 else -negative)
    return w


def least_ratio(sets, n_u, n_p, least_share):
    ratios = [Q.MOST_PRIOR] + [u / n_u / (p / n_p) * (1 + math.sqrt(1 / p + 1 / max(u, 1))) for u, p in sets if p >= max(least_share * n_p, 1)]
    return min(ratios)


def rising(share, below):
    """The rising step function nearest to share / below, by all stretches; bins without rows are as the one before."""
    some = [i for i, b in enumerate(below) if b]
    out, last = [], 0.0
    for i in range(len(below)):
        if below[i]:
            at = some.index(i)
            mean = lambda a, b: sum(share[k] for k in some[a : b + 1]) / sum(below[k] for k in some[a : b + 1])
            last = max(min(mean(a, b) for b in range(at, len(some))) for a in range(at + 1))
        out.append(min(max(last, 0.0), 1.0))
    return out


def model(spark, docs, labels):
    """Score of each (doc_id, text), from quality by doc_id."""
    rows = [(i, [float(np.float32(statistics(t)[name])) for name in Q.STATISTICS]) for i, t in docs]
    table = spark.createDataFrame([(k, i, x) for k, (i, x) in enumerate(rows)], "k int, doc_id long, stats array<float>")
    # the two halves of the training rows are dealt by a hash that only Spark has
    marks = {r.k: (r.out, r.half) for r in table.select("k", Q.held_out().alias("out"), (F.pmod(F.xxhash64("doc_id", "stats"), F.lit(2)) == 1).alias("half")).collect()}
    training = [k for k in range(len(rows)) if not marks[k][0]]
    trusted = {i for i, q in labels.items() if q == 1}
    n = len(training)
    cuts = []
    for c in range(len(Q.STATISTICS)):
        ordered = sorted(rows[k][1][c] for k in training)
        cuts.append(sorted({ordered[math.ceil(q / Q.BINS * n) - 1] for q in range(1, Q.BINS)}))
    x = {k: encode(rows[k][1], cuts) for k in range(len(rows))}
    positives = [k for k in training if rows[k][0] in trusted]

    def fitted(prior):
        made = lambda part: least_risk([x[k] for k in part if k in set(positives)], [x[k] for k in part], prior, Q.RIDGE + Q.RIDGE_ROWS / len([k for k in part if k in set(positives)]))
        whole, halves = made(training), [made([k for k in training if marks[k][1] == h]) for h in (False, True)]
        every, good = [0] * len(Q.GRID), [0] * len(Q.GRID)
        for k in training:
            g = x[k] @ halves[not marks[k][1]]
            at = min(sum(edge < g for edge in Q.GRID), len(Q.GRID) - 1)
            every[at] += 1
            good[at] += k in set(positives)
        return whole, every, good

    guess = least_ratio([(sum(x[k][c] for k in training), sum(x[k][c] for k in positives)) for c in range(len(x[0]))], n, len(positives), Q.LEAST_SHARE)
    _, every, good = fitted(guess)
    ends = [(sum(every[a:]), sum(good[a:])) for a in range(len(every))]
    prior = least_ratio(ends, n, len(positives), Q.LEAST_END)
    whole, every, good = fitted(prior)
    steps = rising([prior * p / len(positives) * n for p in good], every)
    out = {}
    for k, (i, _) in enumerate(rows):
        g = float(x[k] @ whole)
        place = min(max((g - Q.GRID[0]) / (Q.GRID[1] - Q.GRID[0]), 0.0), len(steps) - 1.0)
        low = min(int(place), len(steps) - 2)
        step = steps[low] + (steps[low + 1] - steps[low]) * (place - low)
        out.setdefault(i, set()).add(min(max((1 - Q.WITHIN) * step + Q.WITHIN / (1 + math.exp(-2 * g)), 0.0), 1.0))
    return out, marks, rows


def test_statistics_against_loops(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()][:60] + [(-1, None), (-2, ""), (-3, " \n"), (-4, "a"), (-5, "Été! été! 12 -- x.")]
    got = {r.doc_id: r.stats for r in Q.statistics_of(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        assert got[i] == pytest.approx([statistics(t)[name] for name in Q.STATISTICS], rel=1e-6, abs=1e-7)


def test_query_against_loops(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    want, marks, rows = model(spark, docs, labels)
    held = {rows[k][0]: out for k, (out, _) in marks.items()}
    got = queries.op3_pu_quality(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == held[r.doc_id] and r.predicted == int(r.score >= 0.7)
        assert any(r.score == pytest.approx(w, rel=1e-6, abs=1e-9) for w in want[r.doc_id])
