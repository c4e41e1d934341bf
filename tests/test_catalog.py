"""Every catalogued query against its DuckDB SQL, and the driver entry without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from textmill import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for path in Path(SF_DIR).iterdir():
        files = f"{path}/*" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(rows, order):
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    want = plain(found.fetchall(), [names.index(c) for c in columns])
    assert plain(df.collect(), [df.columns.index(c) for c in columns]) == want


def test_entry_without_training_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "textmill", tmp_path / "textmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[0] == str(len(catalog.QUERIES))
