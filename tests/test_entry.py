"""The registered queries of the engine against their SQL, on the smallest tables; skipped where these aren't there."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tidewater.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name not in ORACLE_SQL:
        df.collect()
        return
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    assert plain(df.select(*[f"`{c}`" for c in found.columns]).collect()) == plain(found.fetchall())


@pytest.mark.parametrize("name", ["nested_pass", "spark_nested"])
def test_tables_of_several_files(spark, tmp_path, name):
    """A table may be a folder of part files; vectors may be null or hold nulls."""
    for k in range(3):
        vectors = pa.table({"vec_id": [2 * k, 2 * k + 1], "embedding": pa.array([[k + 0.5, None, 2.0], [[None, 1.0], None, [7.0]][k]], pa.list_(pa.float32())), "label": pa.array([k, None], pa.int32())})
        (tmp_path / "embeddings.parquet").mkdir(exist_ok=True)
        pq.write_table(vectors, tmp_path / f"embeddings.parquet/part-{k}.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    found = c.sql(ORACLE_SQL.get(name, "select * from embeddings"))
    df = QUERIES[name](spark, str(tmp_path))
    assert df.columns == found.columns and plain(df.collect()) == plain(found.fetchall())


@pytest.mark.parametrize("name", ["nested_pass", "spark_nested"])
def test_vectors_without_elements(spark, tmp_path, name):
    vectors = pa.table({"vec_id": range(5), "embedding": pa.array([[], None, [None], [1.5], [math.nan, -0.0]], pa.list_(pa.float32())), "label": pa.array([1, None, 2, 3, 4], pa.int32())})
    pq.write_table(vectors, tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    found = c.sql(ORACLE_SQL.get(name, "select * from embeddings"))
    df = QUERIES[name](spark, str(tmp_path))
    assert df.columns == found.columns and plain(df.collect()) == plain(found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_without_the_subpackage(tmp_path):
    """The folders for training data and the pipeline can be taken away."""
    top = Path(entry.__file__).resolve().parent
    for name in ("tidewater", "tests"):
        shutil.copytree(top / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (top / name).exists():
            shutil.copy(top / name, tmp_path / name)
    for left in (True, False):
        if not left:
            (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e, tidewater.cli; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
        assert said.returncode == 0, said.stderr
        assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))]
