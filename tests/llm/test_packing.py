"""Packed sequences against the tokenizer itself and a plain dynamic programme."""

import random
import struct
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import corpus as C  # noqa: E402

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from lodestone.llm import packing, queries  # noqa: E402
from lodestone.llm.packing import Tokens, Windows, cuts, pack  # noqa: E402

PATH = P.path("word_bpe_49k.json")
ODD = ["á b ́c x y <|endoftext|> q<|startoftext|>z  'S it's İ ΣΣ ẞ .,! x", "don't I'LL 12345 ½ ❤️ é ﬁ a.b, c!? d", "\x85 x　y\n...", "Ǆ ŉ. ﬀi; Ω K"]


def least(places, prices, size, shortest):
    """The least cost of windows that end at each cut."""
    cost = [0]
    at = [0, *places]
    for j in range(1, len(at)):
        pad = lambda n: 0 if n & (n - 1) == 0 and n >= shortest else size - n
        cost.append(prices[j - 1] + min(cost[i] + pad(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= size))
    return cost[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 30)), min_size=1, max_size=80), st.integers(1, 9), st.sampled_from([200, 1 << 20]))
def test_windows_cost_the_least(steps, batch, lookahead):
    places, prices = np.cumsum([a for a, _ in steps]), np.array([b for _, b in steps])
    w, ends = Windows(64, lookahead), []
    for i in range(0, len(places), batch):
        w.extend(places[i : i + batch], prices[i : i + batch])
        ends += w.settled()
    ends += w.settled(final=True)
    assert ends[-1] == places[-1] and set(ends) <= set(places.tolist())
    sizes = np.diff([0, *ends])
    assert sizes.max() <= 64
    price = dict(zip(places.tolist(), prices.tolist(), strict=True))
    total = sum(price[e] for e in ends) + sum(0 if n & (n - 1) == 0 and n >= 8 else 64 - n for n in sizes.tolist())
    want = least(places.tolist(), prices.tolist(), 64, 8)
    # where ways do not meet in time, one window's padding may be lost at each time
    assert total == want if lookahead > 10**6 else want <= total <= want + 64 * (1 + places[-1] // lookahead)


def test_cuts():
    places, prices = cuts(np.array([0, 10, 210, 211]), np.array([5, 30]), 64)
    assert places.tolist() == [5, 10, 30, 94, 158, 210, 211] and prices.tolist() == [packing.SENTENCE, 0, packing.SENTENCE, packing.INSIDE, packing.INSIDE, 0, 0]


def test_ids_of_words_are_those_of_texts(spark, small):
    tokens, own = Tokens(PATH), Tokenizer.from_file(PATH)
    texts = [t or "" for _, t in C.awkward(20)] + ODD + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    raw, offsets = packing.ts.flat(packing.pa.array(texts))
    for _ in range(2):  # the second time, all words are known
        ids, begin, _ = packing.tokenized(tokens, raw, offsets)
        for i, t in enumerate(texts):
            assert ids[begin[i] : begin[i + 1]].tolist() == [*own.encode(t, add_special_tokens=False).ids, 1]


def held(rows, docs, size=2048):
    """All that the contract asks of the pieces of (doc_id, text), with distinct ids."""
    own, per, sequences = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        per[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(per) == {i for i, _ in docs}
    for i, t in docs:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(per[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, sum(r.length for r in rows)


def test_op11(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    padding, total = held(queries.op11_packing(spark, small).collect(), docs)
    assert padding < 0.02 * total


def test_awkward_texts(spark):
    """Nulls, empty texts, one very long text, texts without white space, repeated rows and rows without id."""
    docs = C.awkward(20) + [(i, t) for i, t in enumerate(ODD, 900)] + [(990, "word" * 20000), (991, "a b. " * 9000)]
    table = C.frame(spark, docs).coalesce(1)
    padding, total = held(pack(table, PATH).collect(), docs)
    assert padding < 0.02 * total
    small = [(1, "a b"), (1, "a b"), (None, "c"), (None, None)]
    rows = pack(spark.createDataFrame(small, "doc_id long, text string").coalesce(1), PATH, size=64).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 3), ("1", 3), ("None", 1), ("None", 2)] and len({r.sequence_id for r in rows}) == 1
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    with pytest.raises(ValueError):
        pack(table, PATH, size=100)


def test_windows_of_equal_steps_are_settled():
    """Where all cuts lie on one grid, ways never meet: they are settled after the lookahead all the same."""
    w, n = Windows(64, 256), 0
    for i in range(40):
        w.extend(np.arange(8) * 8 + 8 + 64 * i, np.array([random.Random(i).randrange(5) for _ in range(8)]))
        n += len(w.settled())
        assert w.place[-1] - w.place[0] <= 256 + 64
    assert n > 30
