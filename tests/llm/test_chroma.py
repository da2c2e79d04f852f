"""Chroma fingerprints and alignment, held against plain loops and all pairs."""

import io
import sys
import wave
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus as C  # noqa: E402

from lodestone.llm import chroma, queries, textscan  # noqa: E402

RATE = 11025


def tune(seed, notes, noise=0.0):
    rng = np.random.default_rng(seed)
    t = np.arange(RATE // 4) / RATE
    sound = np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * t) + 0.5 * np.sin(2 * np.pi * 440 * 2 ** (rng.integers(0, 24) / 12) * t) for _ in range(notes)])
    return sound + noise * np.random.default_rng(seed + 1).normal(size=len(sound))


def as_wav(sound, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes(np.repeat((sound * 8000).astype("<i2"), channels).tobytes())
    return out.getvalue()


def flat(*blobs):
    return textscan.flat(pa.array(blobs, pa.binary()))


def test_pitch_classes_of_plain_tones():
    s = chroma.Settings()
    for k in range(12):
        t = np.arange(RATE) / RATE
        image, first = chroma.chroma(chroma.wav(*flat(as_wav(np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t)))), s)
        assert first.tolist() == [0, 1 + (RATE - s.frame) // s.hop] and (image.argmax(1) == k).all()


def test_codes_against_loops():
    rng = np.random.default_rng(3)
    image, first = rng.integers(0, 256, (40, 12)), np.array([0, 3, 3, 40])
    window = 8
    packed, begin = chroma.codes(image, first, window)
    want = []
    for a, b in zip(first[:-1], first[1:]):
        own = image[a:b]
        if len(own) and len(own) < window:
            own = np.vstack((own, np.zeros((window - len(own), 12), int)))
        for t in range(len(own) - window + 1):
            code = 0
            for kind, at, width, low, height in chroma.filters(window):
                part = own[t + at : t + at + width, low : low + height]
                w, h = width // 2, height // 2
                one = {0: part[:w].sum(), 1: part[:, :h].sum(), 2: part[:w, :h].sum() + part[w:, h:].sum(), 3: part[:, height // 4 : height // 4 + h].sum()}[kind]
                x, y = one + 1, part.sum() - one + 1
                level = int(x * chroma.CLEAR > y) + int(x > y) + int(x > y * chroma.CLEAR)
                code = code << 2 | (level ^ level >> 1)
            want.append(code)
    assert packed.tolist() == want and begin.tolist() == [0, 1, 1, 31]


def test_marks_of_every_run():
    rng = np.random.default_rng(4)
    packed, first = rng.integers(0, 40, 200).astype(np.uint32), np.array([0, 5, 5, 100, 200])
    of, place = chroma.marks(packed, first, 8)
    for r, (a, b) in enumerate(zip(first[:-1], first[1:])):
        mine = {int(packed[a + p]) for p in place[of == r]}
        assert len(mine) == (of == r).sum()
        for s in range(a, max(a + 1, b - 8 + 1)) if b > a else ():
            assert mine & set(packed[s : min(b, s + 8)].tolist())


def test_recordings_align(spark):
    whole = tune(1, 60)
    cut = whole[24 * 1365 :]
    rows = [
        (1, as_wav(whole)), (2, as_wav(whole, 2)), (3, as_wav(tune(1, 60, 0.05))), (4, as_wav(cut[: RATE * 8])), (5, as_wav(tune(7, 60))), (6, as_wav(tune(9, 40))),
        (7, None), (8, b""), (9, b"no sound at all"), (10, as_wav(np.zeros(RATE * 4))), (11, as_wav(np.zeros(RATE * 5))), (12, as_wav(whole[:500])), (None, as_wav(whole)), (2, as_wav(whole, 2)),
    ]
    df = spark.createDataFrame([(i, m, "x", 1) for i, m in rows], "doc_id long, media binary, rec string, offset int")
    got = chroma.align(df).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    assert [of[i].class_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [1, 1, 1, 1, 5, 6, 7, 8, 9]
    assert of[2].match_id == 1 and (of[2].offset, of[2].n_errors) == (0, 0) and of[None].class_id == 1
    assert of[4].offset == 24 and of[4].n_errors == 0
    assert of[11].class_id == 10 and (of[7].n_frames, of[8].n_frames, of[9].n_frames, of[12].n_frames) == (0, 0, 0, 1)
    assert len({(r.class_id, r.n_links, r.n_over) for r in got if r.doc_id == 2}) == 1
    assert chroma.align(df.limit(0)).count() == 0


def classes_of_all_pairs(prints):
    """Least id of each class, when all pairs are compared at all offsets."""
    group = {i: i for i in prints}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(i for i in prints if len(prints[i]))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = np.frombuffer(prints[a], "<u4"), np.frombuffer(prints[b], "<u4")
            for offset in range(-(len(y) // 2) - 1, len(x)):
                n, wrong = chroma.bit_errors(prints[a], prints[b], offset)
                if n and n >= chroma.OVERLAP * len(y) and wrong <= 32 * chroma.BIT_ERRORS * n and n >= 8:
                    p, q = sorted((root(a), root(b)))
                    group[q] = p
                    break
    return {i: root(i) for i in prints}


def test_texts_played_against_all_pairs(spark):
    docs = C.awkward(60)
    df = C.frame(spark, docs)
    got = {r.doc_id: r for r in chroma.align(df, chroma.melody, chroma.MELODY, "text").collect()}
    want = classes_of_all_pairs({i: bytes(r.codes) for i, r in got.items()})
    texts = dict(docs)
    first = {t: i for i, t in sorted(docs, reverse=True)}
    # exact copies are no test of the alignment
    linked = [i for i in want if want[i] != i and first[texts[i]] == i]
    assert len(linked) >= 4 and sum(got[i].class_id == want[i] for i in linked) >= 0.9 * len(linked)
    assert all(got[i].class_id == i for i in want if want[i] == i and len(got[i].codes) >= 32)
    assert all(got[i].class_id == min(j for j in texts if texts[j] == texts[i]) for i in (100, 101, 102, 103, 104))


def test_classes_of_a_table_against_codes_in_common(spark, small):
    """All documents: classes of texts that are no exact copies, against all pairs that have a code in common, at its offset."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in chroma.align(docs, chroma.melody, chroma.MELODY, "text").collect()}
    own = {i: np.frombuffer(bytes(r.codes), "<u4") for i, r in got.items()}
    reps = [i for i in sorted(own) if len(own[i]) >= 8 and not any(j < i and np.array_equal(own[j], own[i]) for j in own)]
    group = {i: i for i in reps}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for k, a in enumerate(reps):
        for b in reps[k + 1 :]:
            for code in np.intersect1d(own[a], own[b]):
                offset = int(np.flatnonzero(own[a] == code)[0] - np.flatnonzero(own[b] == code)[0])
                n, wrong = chroma.bit_errors(own[a].tobytes(), own[b].tobytes(), offset)
                if n >= max(8, chroma.OVERLAP * len(own[b])) and wrong <= 32 * chroma.BIT_ERRORS * n:
                    p, q = sorted((root(a), root(b)))
                    group[q] = p
    linked = [i for i in reps if root(i) != i]
    assert sum(got[i].class_id == got[root(i)].class_id for i in linked) >= 0.9 * len(linked)


def test_very_long_score(spark):
    w = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
    got = {r.doc_id: r for r in chroma.align(spark.createDataFrame([(1, w), (2, w[len(w) // 3 :]), (3, "a " * 50_000), (4, "a " * 9)], "doc_id long, text string"), chroma.melody, chroma.MELODY, "text").collect()}
    assert got[2].class_id == 1 and got[2].n_errors < 200 and got[3].class_id == 3


def test_query(spark, small):
    got = queries.op6_chroma(spark, small)
    rows = got.collect()
    assert got.columns == ["doc_id", "n_frames", "class_id", "n_links", "match_id", "offset", "n_over", "n_errors", "codes_sha256"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    of = {r.doc_id: r.class_id for r in rows}
    assert all(of[i] == of[first[t]] for i, t in texts.items() if t)


if __name__ == "__main__":
    pytest.main([__file__])


def _made(spark, rows):
    """Recordings as (id, codes, marks by place)."""
    kind = "id long, tag int, named boolean, codes binary, marks array<int>, places array<int>"
    return spark.createDataFrame([(i, 0, True, bytearray(np.array(codes, "<u4").tobytes()), [int(np.uint32(codes[p]).view(np.int32)) for p in at], at) for i, codes, at in rows], kind)


def test_common_marks_link_recordings_beyond_the_first(spark):
    """A mark that many have: the last two are nearly alike, but have only this mark in common."""
    rng = np.random.default_rng(4)
    codes = [rng.integers(0, 1 << 32, 40, np.uint64).astype(np.uint32) for _ in range(13)]
    for c in codes:
        c[20] = 77
    # codes of 12 are those of 11 with one bit turned; 13 and 14 are copies of 12
    codes[12] = np.where(np.arange(40) == 20, codes[11], codes[11] ^ np.uint32(4)).astype(np.uint32)
    rows = [(i, c, [3, 20, 33]) for i, c in enumerate([*codes, codes[12], codes[12]])]
    assert sorted((r.id, r.lead_id, r.offset, r.n_errors) for r in chroma.alignments(_made(spark, rows)).collect() if r.id in (11, 12)) == [(12, 11, 0, 39)]
    found = chroma.alignments(_made(spark, rows)).select("id", "lead_id").collect()
    assert {r.id for r in found} == {12, 13, 14}


def test_all_offsets_of_a_pair_are_looked_at(spark):
    """Four offsets have two marks each, the right one has one."""
    a = np.random.default_rng(5).integers(0, 1 << 32, 60, np.uint64).astype(np.uint32)
    b = (a ^ np.uint32(4)).astype(np.uint32)
    b[50] = a[50]
    for k, off in enumerate((3, 5, 7, 9)):
        for j in (0, 1):
            b[10 * k + j] = a[10 * k + j + off]
    at = sorted({50, *(10 * k + j for k in range(4) for j in (0, 1))})
    there = sorted({50, *(10 * k + j + off for k, off in enumerate((3, 5, 7, 9)) for j in (0, 1))})
    links = chroma.alignments(_made(spark, [(1, a, there), (2, b, at)])).collect()
    assert [(r.id, r.lead_id, r.offset) for r in links] == [(2, 1, 0)]


def test_links_of_many_alike_against_all_pairs(spark, monkeypatch):
    """Near copies whose marks many have, some long: every pair is looked at, whether listed or in cells, in several rounds or one."""
    rng = np.random.default_rng(6)
    rows = []
    for family in range(3):
        stem = rng.integers(0, 1 << 32, 60 + 200 * family, np.uint64).astype(np.uint32)
        for k in range(14):
            own = stem.copy()
            turned = rng.choice(len(own), len(own) // 16 * (1 + k % 4), replace=False)
            own[turned] = rng.integers(0, 1 << 32, len(turned), np.uint64).astype(np.uint32)
            own = own[rng.integers(0, 12) :]
            rows.append((100 * family + k, own, sorted(rng.choice(len(own), len(own) // 4, replace=False).tolist())))
    want = set()
    for a, x, at_a in rows:
        for b, y, at_b in rows:
            if b <= a:
                continue
            shared = [int(q) - p for p in at_b for q in np.flatnonzero(x == y[p]) if int(q) in set(at_a)]
            for off in set(shared):
                n, wrong = chroma.bit_errors(x.tobytes(), y.tobytes(), off)
                if n >= chroma.OVERLAP * len(y) and wrong <= 32 * chroma.BIT_ERRORS * n and shared.count(off) >= max(1, np.ceil(len(at_b) * chroma.VOTES)):
                    want.add((b, a))
    assert len(want) > 60
    monkeypatch.setattr(chroma, "ROUND", 100)
    for changed in ({}, {"ROUND": 6, "CELL_ROWS": 5, "PAIRS": 7, "LEADS": 10}):
        for name, value in changed.items():
            monkeypatch.setattr(chroma, name, value)
        links = chroma.alignments(_made(spark, rows)).collect()
        assert {(r.id, r.lead_id) for r in links} == want and len(links) == len(want)


def test_tables_of_many_alike_grow_with_the_recordings(spark, monkeypatch):
    """Near copies that are all linked with each other: their links are counted, but no table between has a row for each."""
    rng, counts, real = np.random.default_rng(8), [], chroma.written
    stem = [f"w{k}" for k in rng.integers(0, 5000, 400)]

    def counted(df, what, *args, **kwargs):
        out = real(df, what, *args, **kwargs)
        counts.append((what, out.count()))
        return out

    rows = [(i, " ".join([*stem[:at], f"v{i}", *stem[at + 1 :]])) for i, at in enumerate(rng.integers(0, 400, 50).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = chroma.fingerprints(docs, chroma.melody, chroma.MELODY, "text").selectExpr("doc_id id", "0 tag", "true named", "codes", "marks", "places")
    listed = [r.id for r in chroma.alignments(prints).collect()]
    assert len(listed) > 600
    monkeypatch.setattr(chroma, "written", counted)
    got = {r.doc_id: r for r in chroma.align(docs, chroma.melody, chroma.MELODY, "text").collect()}
    assert len({bytes(r.codes) for r in got.values()}) > 45
    assert all(r.class_id == 0 and r.n_links == listed.count(i) for i, r in got.items())
    assert len(counts) >= 3 and all(n <= 50 for _, n in counts), counts


def test_rows_of_cells_against_the_listed_links(spark, monkeypatch):
    """Classes, numbers of links and best links from many small cells and from one, against those of all links; some rows without id, some ids twice."""
    rng = np.random.default_rng(9)
    rows = []
    for family in range(4):
        stem = [f"w{k}" for k in rng.integers(0, 5000, 150 + 100 * family)]
        for k in range(9):
            own = [w if rng.random() > 0.002 * k else f"v{rng.integers(0, 99)}" for w in stem]
            rows.append((None if k == 4 else 100 * (k % 3) + family if k > 5 else int(rng.integers(1000, 9999)), " ".join(own[rng.integers(0, 20) :])))
    rows += [rows[3], rows[13], (7, rows[20][1]), (8, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = chroma.fingerprints(docs, chroma.melody, chroma.MELODY, "text")
    prints = prints.selectExpr("coalesce(doc_id, xxhash64(codes)) id", "cast(pmod(xxhash64(codes), 65536) as int) tag", "doc_id is not null named", "codes", "places", "doc_id").dropDuplicates(["id", "tag"])
    links = chroma.alignments(prints).collect()
    group = {(r.id, r.tag): (r.id, r.tag) for r in prints.collect()}
    names = {(r.id, r.tag): r.doc_id for r in prints.collect()}
    for _ in group:
        for r in links:
            group[(r.id, r.tag)] = group[(r.lead_id, r.lead_tag)] = min(group[(r.id, r.tag)], group[(r.lead_id, r.lead_tag)], key=lambda x: (names[x] is None, x))
    of = {}
    for r in links:
        of.setdefault((r.id, r.tag), []).append(r)
    same = {k: bytes(c) for k, c in ((((r.id, r.tag)), r.codes) for r in prints.collect())}
    for changed in ({}, {"CELL_ROWS": 5, "PAIRS": 7, "ROUND": 3}):
        for name, value in changed.items():
            monkeypatch.setattr(chroma, name, value)
        got = chroma.align(docs, chroma.melody, chroma.MELODY, "text").selectExpr("*", "coalesce(doc_id, xxhash64(codes)) id", "cast(pmod(xxhash64(codes), 65536) as int) tag").collect()
        assert len(got) == len(rows) and sum(r.n_links for r in got) > 40
        for r in got:
            key = (r.id, r.tag)
            own = list(of.get(key, []))
            # a copy has the links of the first one too
            copied = [x for x in own if same[(x.lead_id, x.lead_tag)] == same[key]] if r.codes else []
            own += [x for c in copied for x in of.get((c.lead_id, c.lead_tag), [])]
            assert r.n_links == len(own)
            assert r.class_id == names[group[key]]
            best = min(((x.n_errors / x.n_over, x.lead_id, x.offset, x.n_over, x.n_errors) for x in own), default=None)
            assert (r.match_id, r.offset, r.n_over, r.n_errors) == (best[1:] if best else (None,) * 4)
