"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: None if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted((tuple(show(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data, duck, name):
    got = entry.queries()[name](spark, data)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["hdr_similarity_fuzzy"])
def test_queries_without_sql_run(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry_without_the_training_data_part():
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['docloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_nothing_else_imports_the_training_data_part():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parents[1]
    for f in (root / "docloom").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s+[\w.]*llm", f.read_text(), re.M), f
