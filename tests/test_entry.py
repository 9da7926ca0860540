"""The entry points, with and without the optional packages."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from weftgraph import registry

ROOT = Path(__file__).resolve().parent.parent


def test_the_flagship_runs(spark):
    assert entry.entry(spark).columns == ["level", "source_id", "predicate", "target_id", "type_ok"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.SQL) <= set(registry.QUERIES)


def test_the_library_imports_alone(tmp_path):
    """A copy without the training-data packages still lists its own queries."""
    import shutil

    shutil.copytree(ROOT / "weftgraph", tmp_path / "weftgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout) == len(registry.QUERIES), said.stderr


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_match_their_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = registry.QUERIES[name](spark, sf_dir)
    want = con.execute(registry.SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
