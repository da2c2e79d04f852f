"""Every query that has SQL, against DuckDB on the smallest tables; and the entry module."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lodestone.plans import oracles, store_queries
from lodestone.plans.queries import QUERIES as PLAN_QUERIES

QUERIES = PLAN_QUERIES | store_queries.QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def rows_of(rows):
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(repr(tuple(plain(v) for v in r)) for r in rows)


def test_all_have_oracles():
    assert set(QUERIES) == set(oracles.SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = duck.execute(oracles.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in got.fetchall()]
    assert rows_of(df.select(columns).collect()) == rows_of(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_rest_stands_without_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for name in ("__spark_entry__.py", "lodestone"):
        (tmp_path / name).symlink_to(root / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for p in (root / "lodestone").iterdir():
        if p.name != "llm":
            (tmp_path / "lodestone" / p.name).symlink_to(p)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; assert len(e.queries()) >= 50 and not any(q.startswith('op1') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
