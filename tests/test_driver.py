"""Every query with SQL against DuckDB on the smallest tables; the guard of the entry module."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tracelake import driver, driver_io

QUERIES, ORACLE = driver.queries() | driver_io.queries(), driver.oracle_sql() | driver_io.oracle_sql()
DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def key(x):
    return tuple((v is None, str(v)) for v in x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = duck.execute(ORACLE[name])
    found = [d[0] for d in r.description]
    assert sorted(found) == cols
    want = sorted((tuple(x[found.index(c)] for c in cols) for x in r.fetchall()), key=key)
    assert [key(x) for x in sorted((tuple(x[c] for c in cols) for x in df.collect()), key=key)] == [key(x) for x in want]


def test_every_engine_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_survives_a_missing_package(tmp_path):
    """A package that only the corpus part needs may be missing."""
    (tmp_path / "zstandard.py").write_text("raise ImportError('none here')")
    code = "import __spark_entry__ as e; q = e.queries(); print('trace_search' in q, 'pipeline' in q, 'op7_quality' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{ROOT}"}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "False", "False"] and "left out" in out.stderr, out.stderr


def test_entry_works_without_the_corpus_part(tmp_path):
    """Without the corpus subpackage and the pipeline the entry module imports and keeps the other queries."""
    import shutil

    shutil.copytree(ROOT / "tracelake", tmp_path / "tracelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(QUERIES)), "False", "False"], out.stderr


def test_nothing_else_imports_the_corpus_part():
    for p in (ROOT / "tracelake").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
