"""Runs of words against a model that tries every period."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import corpus as C  # noqa: E402

from lodestone.llm import queries  # noqa: E402
from lodestone.llm import textscan as ts  # noqa: E402
from lodestone.llm.periodic_runs import automaton, gram_words, periodic_runs, runs, stretches  # noqa: E402


def brute(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def row(text, doc_id):
    """The columns of the contract, word by word."""
    w = C.SPACED.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{a},{m},{q}\n" for a, m, q in found)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, C.sha(listed), C.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 12), st.integers(0, 60), st.integers(1, 14))
def test_runs_of_numbers(head, period, more, least):
    words = head + (head[:period] * 60)[:more] + head[:5]
    assert runs(np.array(words, np.int64), least) == brute(words, least)
    hashes, got = ts.mix(np.array(words, np.uint64) + np.uint64(5)), []
    for a, b in stretches(hashes, np.zeros(len(words), int), gram_words(least)):
        got += [(s + a, n, q) for s, n, q in runs(np.unique(hashes[a:b], return_inverse=True)[1], least)]
    assert sorted(got) == brute(words, least)


def test_automaton_has_a_state_for_each_set_of_ends():
    words = [random.Random(4).randrange(3) for _ in range(40)]
    link, length, prefixes = automaton(words)
    subs = {tuple(words[a:b]) for a in range(40) for b in range(a + 1, 41)}
    ends = {frozenset(i for i in range(40) if tuple(words[max(0, i + 1 - len(s)) : i + 1]) == s) for s in subs}
    assert len(link) - 1 == len(ends) and sum(length[i] - length[link[i]] for i in range(1, len(link))) == len(subs) and len(set(prefixes)) == 40


def test_stretches_keep_documents_apart():
    one = ts.mix(np.arange(20, dtype=np.uint64) + np.uint64(1))
    assert stretches(np.concatenate((one, one)), np.repeat([0, 1], 20), 6) == []
    assert stretches(np.concatenate((one, one)), np.zeros(40, int), 6) == [(0, 40)]


def test_op13(spark, small):
    want = {r.doc_id: row(r.text, r.doc_id) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_periodic_runs(spark, small).collect()} == want
    assert sum(w[0] > 0 for w in want.values()) > 10


def test_awkward_texts(spark, tmp_path):
    """Nulls, blanks of all kinds, long texts, repeated rows, rows without id; ids whose checksum makes texts periodic."""
    chosen = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    docs = C.awkward(30) + [(i, t) for i, (_, t) in zip(chosen, C.awkward(40, 2), strict=False)] + [(1, "a b"), (1, "a b"), (None, "x \t y\n" * 30), (None, None), (5000, "\x0b\x0c a b\x85 " * 20), (5001, "w " * 5000)]
    C.frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(repr((r.doc_id, *[r[c] for c in COLUMNS])) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert got == sorted(repr((i, *row(t, i))) for i, t in docs)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs(empty).count() == 0
