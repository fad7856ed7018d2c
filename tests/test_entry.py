import importlib.util
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    ids = [r.doc_id for r in entry.entry(spark).collect()]
    assert ids == sorted(ids, reverse=True)


@needs_data
def test_search_queries_agree_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from sieveline import queries

    con = duckdb.connect()
    for name in ("documents", "labels", "conversations", "pages", "region", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, run in queries.QUERIES.items():
        df = run(spark, DATA)
        cursor = con.execute(queries.SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns), name
        assert sorted(map(tuple, df.select(columns).collect())) == sorted(cursor.fetchall()), name


def test_imports_without_the_optional_parts(tmp_path):
    root = os.path.dirname(entry.__file__)
    for name in ("__spark_entry__.py", "sieveline"):
        os.symlink(f"{root}/{name}", tmp_path / name) if name.endswith(".py") else None
    import shutil

    shutil.copy(f"{root}/__spark_entry__.py", tmp_path / "entry.py")
    os.unlink(tmp_path / "__spark_entry__.py")
    shutil.copytree(f"{root}/sieveline", tmp_path / "sieveline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import entry; q = entry.queries(); assert 'term' in q and not any(n.startswith('op1_') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    assert importlib.util.find_spec("sieveline") is not None
