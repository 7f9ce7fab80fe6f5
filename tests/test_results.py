"""Stored results, cursors, asynchronous queries, the command line."""

import io
import json
import re

import pytest

from tidewater import errors
from tidewater.cli import main, run_statements
from tidewater.engine import Engine, Status
from tidewater.operators.ranges import boundaries, range_column, range_number, sample_boundaries
from tidewater.operators.results import END, LAST, START, Cursor, Result, write_result
from tidewater.render import shown, table
from tidewater.sources.connections import Connections, FileConnection, S3Connection
from tidewater.sources.datagen import write_sample
from tidewater.streaming.files import stream, write_stream


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('result')}/r"
    df = spark.range(1000).repartition(5).orderBy("id")
    write_result(df, path)
    return Result(spark, path, df.schema)


def ids(page):
    return [r[0] for r in page.rows]


def test_forward_and_backward(stored):
    for limit in (97, 250, 1000, 5000):
        assert [i for p in stored.pages(limit) for i in ids(p)] == list(range(1000))
        back = [ids(p) for p in stored.pages(limit, forward=False)]
        assert [i for p in reversed(back) for i in p] == list(range(1000))


def test_one_page(stored):
    page = stored.page(START, 10)
    assert ids(page) == list(range(10)) and page.first == page.offsets[0]
    again = stored.page(page.offsets[7], 4)
    assert ids(again) == [7, 8, 9, 10] and ids(stored.page(again.offsets[-1].next(), 1)) == [11]
    back = stored.page(page.offsets[7], 4, forward=False)
    assert ids(back) == [4, 5, 6, 7] and back.first == back.offsets[-1]
    assert ids(stored.page(page.offsets[2], 8, forward=False)) == [0, 1, 2]
    assert ids(stored.page(page.offsets[2], 8, forward=False, allow_overflow=True)) == list(range(8))
    assert ids(stored.page(END, 3, forward=False)) == [997, 998, 999]
    assert stored.page(END, 3) is None and stored.page(START, 0) is None
    assert ids(stored.page(Cursor(0, LAST, LAST), 1, forward=False))[0] < 1000


def test_duplicate_names(engine, spark):
    spark.range(3).createOrReplaceTempView("three")
    with pytest.raises(errors.QueryFailedError, match="several columns"):
        engine.run("select id, id from three")


def test_lifecycle(engine, spark):
    spark.range(100).createOrReplaceTempView("hundred")
    handle = engine.submit("select id from hundred where id < 30 order by id desc")
    assert handle.wait(60) is Status.COMPLETE and engine.query(handle.id) is handle
    assert ids(handle.page(limit=5)) == [29, 28, 27, 26, 25]
    pager = handle.pager()
    assert ids(pager.first(20))[-1] == 10 and ids(pager.next(20)) == list(range(9, -1, -1))
    assert len(ids(pager.next(20))) == 10 and ids(pager.next(20, forward=False))[0] == 29
    empty = engine.run("select * from read_files('nothing*.parquet')")
    assert empty.page() is None and empty.result.count() == 0
    with pytest.raises(errors.QueryNotFoundError):
        engine.query("none")
    bad = engine.submit("select 1 / (id - 50) as x from hundred")
    assert bad.wait(60) is Status.ERROR and "zero" in bad.error.lower()
    with pytest.raises(errors.QueryFailedError):
        bad.page()


def test_cancel(engine, spark):
    spark.range(0, 10**11, 1, 4).createOrReplaceTempView("endless")
    handle = engine.submit("select id from endless where id % 1000003 = 1000004")
    while handle.status is Status.QUEUED:
        handle.wait(0.05)
    handle.wait(2)
    handle.cancel()
    assert handle.wait(60) is Status.CANCELLED


def test_sample_data_and_queries(spark, tmp_path):
    write_sample(spark, str(tmp_path), "simple")
    assert len(list((tmp_path / "simple").rglob("*.parquet"))) == 4
    engine = Engine(spark, root=str(tmp_path), scan_order=True)
    files = "read_files('simple/*.parquet')"
    assert engine.sql(f"select * from {files}").columns[:3] == ["id", "value1", "value2"]
    counts = {"id < 25": 25, "id > 25": 74, "id < 75": 75, "id % 2 = 0": 50, "id > 25 + 0.0": 74}
    for where, n in counts.items():
        assert engine.sql(f"select id, value2 from {files} where {where}").count() == n
    df = engine.sql(f"select id, value1, id + 10.0 as p, (value2 + 10) / 100 as value2, 1.0 / id as a, 1.0 / (id * id) as b, id * id as c from {files} where id > 25 + 0.0")
    assert [t for _, t in df.dtypes] == ["int", "string", "float", "float", "float", "float", "int"]
    assert [r[0] for r in engine.sql(f"select id from {files} where id < 25 order by id desc").collect()] == list(range(24, -1, -1))
    assert ids(engine.run(f"select id from {files}").page(limit=100)) == list(range(100))
    out = io.StringIO()
    assert run_statements(engine, [f"select id from {files} where id < 2", "select nothing from t"], 10, 60, True, out) == 1 and "UnknownTableError" in out.getvalue()
    assert "| 1  |" in out.getvalue()


def test_command_line(spark, tmp_path):
    write_sample(spark, str(tmp_path), "simple")
    sql = tmp_path / "q.sql"
    sql.write_text("select id from read_files('simple/*.parquet') where id = 3; select x from read_files('simple/*.parquet'); select 1 as one from read_files('simple/*.parquet') where id < 0")
    out = io.StringIO()
    assert main(["file", str(sql), "--root", str(tmp_path), "--all"], out) == 1
    assert "| 3  |" in out.getvalue() and "ColumnNotFoundError" in out.getvalue() and "statement 3 of 3" in out.getvalue()


def test_view(spark, tmp_path):
    """Moves through results by keys; a failing statement is passed over."""
    write_sample(spark, str(tmp_path), "simple")
    sql = tmp_path / "q.sql"
    sql.write_text("select id from read_files('simple/*.parquet') order by id; select nothing from t; select id from read_files('simple/*.parquet') where id = 3")
    out = io.StringIO()
    assert main(["view", str(sql), "--root", str(tmp_path), "--page", "10"], out, io.StringIO("n\np\nl\n4\nf\ns\nq\n")) == 1
    shown_pages = [re.findall(r"\| (\d+) +\|", part) for part in out.getvalue().split("q quit")]
    assert shown_pages == [[str(k) for k in rows] for rows in (range(10), range(10, 20), range(10), range(90, 100), range(90, 94), range(4), [3])] + [[]]
    assert "UnknownTableError" in out.getvalue()


def test_folders_of_many_files(spark, tmp_path):
    """Where a pattern matches all files of a folder, Spark is given the folder; a file that doesn't match keeps out."""
    from tidewater.sources.globs import matching_files

    for name in ("d/a.parquet", "d/e/b.parquet", "d/e/k=1/c.parquet"):
        spark.range(3).coalesce(1).write.parquet(f"file://{tmp_path}/tmp-{name.replace('/', '-')}")
        (found,) = (tmp_path / f"tmp-{name.replace('/', '-')}").glob("*.parquet")
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        found.rename(tmp_path / name)
    engine = Engine(spark, root=str(tmp_path))
    root = f"file://{tmp_path}"
    assert matching_files(spark, root, "d/*.parquet").folder.endswith("/d") and matching_files(spark, root, "d/e/b*").folder is None
    df = engine.sql("select * from read_files('d/*.parquet')")
    assert df.columns == ["id"] and df.count() == 9
    assert engine.sql("select * from read_files('d/e/b*')").count() == 3


def test_connections(tmp_path):
    config = {"connections": [{"name": "default", "connection_type": {"Fs": {"root": str(tmp_path)}}}, {"name": "s", "connection_type": {"S3": {"endpoint": "http://localhost:9000", "access_key_id": "a", "secret_access_key_id": "b", "bucket": "bk", "root": "/r/", "region": "eu", "force_path_style": True}}}]}
    (tmp_path / "c.json").write_text(json.dumps(config))
    found = Connections.from_file(str(tmp_path / "c.json"))
    assert found.get().url == f"file://{tmp_path}" and found.get("s").url == "s3a://bk/r"
    assert found.get("s").settings()["fs.s3a.bucket.bk.path.style.access"] == "true" and "b'" not in repr(found.get("s"))
    with pytest.raises(errors.ConnectionConfigError):
        found.add("s", S3Connection("e", "a", "b", "c"))
    for name in ("", "ü"):
        with pytest.raises(errors.ConnectionConfigError):
            found.add(name, FileConnection("/"))
    for text in ("{", "{}", '{"connections": [{"name": "x"}]}', '{"connections": [{"name": "x", "connection_type": {"Ftp": {}}}]}'):
        (tmp_path / "c.json").write_text(text)
        with pytest.raises(errors.ConnectionConfigError):
            Connections.from_file(str(tmp_path / "c.json"))


def test_ranges(spark):
    keys = [(None, None), (None, 0), (None, 1), ("a", None), ("a", 0), ("a", 0), ("c", 0)]
    bounds = boundaries(keys, 3)
    assert len(bounds) == 2 and [range_number(k, bounds) for k in keys] == sorted(range_number(k, bounds) for k in keys)
    bounds = [(None, 1), ("a", 0)]
    rows = [(None, 0), (None, 2), ("b", 0), ("a", 0), ("a", None), (None, 1), (None, None)]
    assert [range_number(r, bounds) for r in rows] == [0, 1, 2, 2, 1, 1, 0]
    df = spark.createDataFrame(rows, "s string, n int")
    assert [r[0] for r in df.select(range_column(["s", "n"], bounds)).collect()] == [range_number(r, bounds) for r in rows]
    assert [range_number(r, [("a", 0)], [True, False]) for r in [("b", 9), ("a", 0), (None, 0)]] == [0, 1, 0]
    assert boundaries([], 4) == [] and boundaries([(1,)] * 9, 4) == []
    assert len(sample_boundaries(spark.range(1000), ["id"], 4)) == 3


@pytest.mark.parametrize("rate", [0.1, 1e-12])
def test_sampled_boundaries_of_a_sorted_table(spark, rate):
    bounds = sample_boundaries(spark.range(0, 40_000, 1, 8), ["id"], 4, rate=rate, most=1000)
    assert [round(b[0] / 10_000) for b in bounds] == [1, 2, 3]


def test_render():
    assert shown("x" * 80) == ["x" * 48, "x" * 27 + "..."] and shown(None) == ["null"]
    assert table(["a"], [[1], ["b" * 50]]).count("\n") == 6


def test_stream(spark, engine, tmp_path):
    schema = spark.range(1).schema
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/in")
    df = stream(engine, "select id * 2 as x from read_files('in') where id > 5", schema)
    write_stream(df, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [12, 14, 16, 18]
    with pytest.raises(errors.UnsupportedError):
        stream(engine, "select id from read_files('in') order by id", schema)


def test_pages_over_many_files(spark, tmp_path, monkeypatch):
    import tidewater.operators.results as module

    monkeypatch.setattr(module, "ROWS_PER_FILE", 7)
    df = spark.range(200).repartition(3).orderBy("id")
    write_result(df, f"file://{tmp_path}/r")
    result = Result(spark, f"file://{tmp_path}/r", df.schema)
    assert len(result._files()) > 28
    for forward in (True, False):
        pages = [ids(p) for p in result.pages(33, forward)]
        assert [i for p in (pages if forward else reversed(pages)) for i in p] == list(range(200))
