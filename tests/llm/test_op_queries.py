"""The opN_ queries and the pipeline on the smallest tables, held against the models."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus as C  # noqa: E402

import corpus_pipeline  # noqa: E402
from lodestone.llm import oracles, queries  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_op1(spark, small, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = {i: (n, h, len(f), C.sha(",".join(f)), c) for i, (n, h, f, c) in C.contamination(docs, items).items()}
    assert by_id(queries.op1_winnowing(spark, small), "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_op4(spark, small, docs):
    want = {i: (n, d, C.sha(t)) for i, (n, d, t) in C.line_dedup(docs).items()}
    assert by_id(queries.op4_line_dedup(spark, small), "n_lines", "n_dropped", "kept_sha256") == want


def test_op7(spark, small, docs):
    listed = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
    want = {}
    for i, t in docs:
        s = C.secrets(t)
        want[i] = (*[sum(k == kind for k, _, _ in s) for kind in ("assign", "access", "hex")], C.sha(listed(s)), listed(s))
    assert by_id(queries.op7_blob_ledger(spark, small), "n_assign", "n_access", "n_hex", "base_sha256", "spans") == want


def test_op8(spark, small, docs):
    want = C.unigrams(docs, [(i, t) for i, t in docs if C.fold(i, 7) != 2])
    got = by_id(queries.op8_ppm(spark, small), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for i, (held, *counts, base, score) in got.items():
        assert held == (C.fold(i, 7) == 2) and tuple(counts) == want[i][:3] and base == pytest.approx(want[i][3]) and score < 0


def test_op9(spark, small, docs):
    assert by_id(queries.op9_jaccard_join(spark, small), "n_shingles", "component_id") == C.near_duplicates(docs)


def test_op10(spark, small, docs):
    assert by_id(queries.op10_suffix_dedup(spark, small), "n_bytes", "n_removed", "n_spans", "kept_sha256") == C.substrings(docs)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = con.execute(oracles.SQL[name])
    names = [c[0] for c in got.description]
    df = queries.QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(names)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == sorted(repr([plain(v) for v in r]) for r in got.fetchall())


def test_op1_sql_with_items_without_id(spark, tmp_path):
    w, v = (" ".join(f"{x}{i}" for i in range(20)) for x in "wv")
    spark.createDataFrame([(None, w), (None, "short one"), (2, v)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, w), (2, f"{v} then {w}"), (3, "clean text"), (4, v), (5, "a short one")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = con.execute(oracles.SQL["op1_winnowing"])
    names = [c[0] for c in got.description]
    want = {r[names.index("doc_id")]: dict(zip(names, r, strict=True)) for r in got.fetchall()}
    assert {r.doc_id: r.asDict() for r in queries.op1_winnowing(spark, str(tmp_path)).collect()} == want and want[1]["n_hit"] == 20


def test_pipeline(spark, small, docs):
    table = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    for name in list(stages)[:-1]:
        assert stages[name](spark, table, small).columns == table.columns
    cut = {i: t for i, (_, _, t) in C.line_dedup(docs).items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in stages["line dedup"](spark, table, small).collect()} == {i: (t, len(t)) for i, t in cut.items()}
    groups = C.near_duplicates(docs, 5, 100, 80)
    assert {r.doc_id for r in stages["n-gram Jaccard join"](spark, table, small).collect()} == {g for _, g in groups.values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = {i for i, c in C.contamination(docs, items).items() if not c[3]}
    assert {r.doc_id for r in stages["benchmark decontamination"](spark, table, small).collect()} == clean
    out = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {i for i, _ in docs}


def test_stages_on_awkward_tables(spark, small):
    """Nulls in any column, repeated rows, no ids, columns with clashing names, empty tables."""
    rows = C.awkward(20)
    names = "doc_id long, text string, source string, lang string, n_chars long, __key int, __map int, __drawn int, __of int, row int, part int"
    odd = [(i, t, None if i % 7 == 0 else "s", None if i % 3 == 0 else "en", None, 1, 2, 3, 4, 5, 6) for i, t in [*rows, rows[3], rows[3]]]
    odd += [(None, rows[2][1], "s", "en", 1, 1, 2, 3, 4, 5, 6), (None, None, None, None, None, None, None, None, None, None, None)]
    table = spark.createDataFrame(odd, names)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, small)
        assert set(table.columns) <= set(out.columns) if k == 4 else out.columns == table.columns
        kept = out.collect()
        assert all((r["__key"], r["row"]) in {(1, 5), (None, None)} for r in kept)
        if k == 1:
            assert len(kept) == len(odd) and all(r.text is not None and r.n_chars == len(r.text) for r in kept)
        if k == 2:
            assert len([r for r in kept if r.doc_id == 3]) == 3 and len([r for r in kept if r.doc_id is None]) == 1
        if k == 3:
            assert len(kept) == len(odd)
        assert stage(spark, table.limit(0), small).count() == 0


def test_quality_and_mixing_stages_against_their_operators(spark, small, docs):
    """The quality stage keeps what scores 0.7; the mixing stage repeats each document as its Poisson number says."""
    table = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = {r.doc_id for r in queries.op3_pu_quality(spark, small).where("predicted = 1").collect()}
    assert {r.doc_id for r in stages["quality classifier"](spark, table, small).collect()} == good
    mixed = stages["mixing sources to target weights"](spark, table, small).collect()
    sizes = {}
    for r in table.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text or "")
    total = sum(s**0.5 for s in sizes.values())
    for r in mixed:
        assert r.rate == pytest.approx(sizes[r.source] ** 0.5 / total * sum(sizes.values()) / sizes[r.source], rel=1e-6)
    per = {}
    for r in mixed:
        per.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in per.values())
    assert [r.doc_id for r in mixed] != sorted(r.doc_id for r in mixed)
