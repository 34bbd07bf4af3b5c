"""Every catalog query against its SQL oracle on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from rangeloom.plans import catalog, workloads

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if sql := catalog.oracle_sql().get(name):
        found = duck.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, found.fetchall())
    else:
        assert got


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("gone", [["rangeloom/llm"], ["rangeloom/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_works_without_optional_parts(tmp_path, gone):
    home, copy = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tmp_path / "copy"
    shutil.copytree(home, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True).stdout
    names = set(said.split())
    assert set(catalog.queries()) <= names and "pipeline" not in names
    assert any(n.startswith("op1_") for n in names) == ("rangeloom/llm" not in gone and (copy / "rangeloom/llm").is_dir())


def test_reduce_custom_takes_negative_and_null_values(spark, duck, tmp_path):
    sql = catalog.oracle_sql()["q_reduce_custom"]
    for name, values in (("some", "CASE i % 4 WHEN 0 THEN NULL WHEN 1 THEN -i * 1.37 ELSE i * 2.11 END"), ("none", "CAST(NULL AS DOUBLE)")):
        path = tmp_path / name / "events.parquet"
        path.parent.mkdir()
        duck.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, i AS user_id, 'view' AS event_type, {values} AS value FROM (SELECT CAST(i AS BIGINT) AS i FROM range(200) t(i))) TO '{path}' (FORMAT parquet)")
        got = catalog.queries()["q_reduce_custom"](spark, str(path.parent)).collect()
        assert [tuple(r) for r in got] == duck.execute(sql.replace("FROM events", f"FROM '{path}'")).fetchall()


def test_sort_comparator_rounds_as_sql_does(spark, duck, tmp_path):
    """Products of single precision that fall on a half where those of double precision do not, and nulls."""
    sql = catalog.oracle_sql()["q_sort_comparator"]
    path = tmp_path / "embeddings.parquet"
    values = "[CAST((i * 64 + k) / 1000.0 + 0.0005 AS FLOAT) * (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) for k in range(64)]"
    duck.execute(f"COPY (SELECT CAST(i AS BIGINT) AS vec_id, CASE i WHEN 7 THEN NULL WHEN 8 THEN [1, NULL, 3, NULL] ELSE {values} END::FLOAT[] AS embedding, 0 AS label FROM range(100) t(i)) TO '{path}' (FORMAT parquet)")
    got = catalog.queries()["q_sort_comparator"](spark, str(tmp_path)).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == duck.execute(sql.replace("FROM embeddings", f"FROM '{path}' ORDER BY vec_id")).fetchall()


@pytest.mark.parametrize("name", ["_edges", "_chain", "q_graph_degrees"])
def test_edges_are_dealt_by_their_number(spark, name, monkeypatch):
    """What a task holds of the edges, or of their nodes, follows BLOCK and not the session's partitions."""
    monkeypatch.setattr(workloads, "BLOCK", 250, raising=False)
    rows = getattr(catalog, name)(spark, DATA)
    sizes = rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert max(r.n for r in sizes) < 500
