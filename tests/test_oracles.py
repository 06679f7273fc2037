"""Every registered query against its SQL twin on the smallest tables, and the entry module without its optional parts."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from memloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    return [round(float(x), 5) for x in value] if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(v) for v in r) for r in df.select(columns).collect()]
    if name not in registry.oracle_sql():
        assert rows
        return
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    zone = lambda x: x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x
    assert sorted(([zone(x) for x in r] for r in rows), key=key) == sorted(([zone(x) for x in r] for r in want), key=key)


def test_consolidation_of_more_than_pairs(spark, con, tmp_path):
    """Threes of near vectors: the twin's groups are not components there."""
    for name, sql in (("documents", "SELECT * FROM documents"), ("embeddings", "SELECT e.vec_id, list_transform(f.embedding, lambda x, i: CASE WHEN i = 1 THEN (x + 0.013 * (e.vec_id % 3))::FLOAT ELSE x END) AS embedding FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id - e.vec_id % 3")):
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
    near = duckdb.connect()
    for name in ("documents", "embeddings"):
        near.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    columns = ["root", "members", "text", "importance", "strength", "keeper", "last_accessed_at", "mean"]
    want = sorted(map(str, near.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()['q_consolidate']})").fetchall()))
    got = registry.queries()["q_consolidate"](spark, str(tmp_path)).select(columns).collect()
    assert max(r.members for r in got) > 2 and sorted(str(tuple(r)) for r in got) == want


def test_entry_module_without_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/memloom", tmp_path / "memloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not [q for q in [*e.queries(), *e.oracle_sql()] if q.startswith('op') or q == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
