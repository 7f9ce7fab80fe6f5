"""Values, names, order and errors of the dialect on Spark."""

import datetime
import math
import random
import threading

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException

from tidewater import errors
from tidewater.engine import Engine
from tidewater.functions.registry import TableFunction


def put(folder, name, **columns):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path)


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def cost(engine, tmp_path):
    put(tmp_path, "cost.parquet", cost=pa.array([10, 20, 30, 40, 50], pa.int32()), good=[True, False, True, False, True], other=[False, True, True, True, False], text=["hello", ", ", "world", "!", None])
    put(tmp_path, "abc.parquet", **{k: pa.array(v, pa.float32()) for k, v in {"a": [0, 1, 2, 3], "b": [1, 1, 3, 2], "c": [0, 0, 1, 2]}.items()})
    return engine


def test_golden_values(cost):
    q = lambda e, t="cost": [r[0] for r in values(cost.sql(f"select {e} as x from read_files('{t}.parquet')"))]
    assert q("cost + 7") == [17, 27, 37, 47, 57]
    assert q("cost = 20") == [False, True, False, False, False]
    assert q("good = true") == [True, False, True, False, True]
    assert q("good = other") == [False, False, True, False, False]
    assert q("a+1.0/(2.0+c)*b", "abc") == [0.5, 1.5, 3.0, 3.5]
    assert cost.sql("select a+1.0/(2.0+c)*b from read_files('abc.parquet')").dtypes == [("unnamed_0", "float")]
    assert q("text = 'world'") == [False, False, True, False, None]
    assert q("text <> 'world'") == [True, True, False, True, None]
    assert q("cost / 7") == [1, 2, 4, 5, 7] and q("-cost % 7") == [-3, -6, -2, -5, -1]
    assert values(cost.sql("select cost from read_files('cost.parquet') where cost < 30")) == [(10,), (20,)]


def test_names(cost):
    df = cost.sql("select cost, cost + 1, text as t, t2.cost, cost * 2 from read_files('cost.parquet') t2")
    assert df.columns == ["cost", "unnamed_1", "t", "unnamed_2", "unnamed_3"]
    assert cost.sql("select t.* from read_files('cost.parquet') t").columns == ["cost", "good", "other", "text"]


@pytest.mark.parametrize("e", ["Cost", "x.cost", "t.x.cost", '"COST"'])
def test_unknown_columns(cost, e):
    with pytest.raises(errors.ColumnNotFoundError):
        cost.sql(f"select {e} from read_files('cost.parquet') t")


@pytest.mark.parametrize("e,kind", [("cost + text", errors.CoercionError), ("good + good", errors.CoercionError), ("text = 1", errors.CoercionError), ("-text", errors.CoercionError), ("1e5 + cost", errors.LiteralError)])
def test_type_errors(cost, e, kind):
    with pytest.raises(kind):
        cost.sql(f"select {e} from read_files('cost.parquet')")


def test_predicate_must_be_boolean(cost):
    with pytest.raises(errors.PredicateTypeError):
        cost.sql("select * from read_files('cost.parquet') where cost + 1")


def test_float_rounding_and_literals(engine, tmp_path):
    put(tmp_path, "n.parquet", u=pa.array([1, 16777217], pa.int32()), d=[0.05, 0.1], big=pa.array([1, 2], pa.int64()))
    assert values(engine.sql("select u + 0.0 as x from read_files('n.parquet')")) == [(1.0,), (16777216.0,)]
    assert values(engine.sql("select d from read_files('n.parquet') where d = 0.05")) == []  # the literal is a float
    assert engine.sql("select 2147483647 as i, 2147483648 as l, -2147483648 as m, 1.5 as f, big + 0.5 as w from read_files('n.parquet')").dtypes == [("i", "int"), ("l", "bigint"), ("m", "int"), ("f", "float"), ("w", "double")]
    strict = Engine(engine.spark, root=str(tmp_path), strict_types=True)
    with pytest.raises(errors.CoercionError):
        strict.sql("select big + 0.5 from read_files('n.parquet')")


def test_overflow_is_an_error(engine, tmp_path):
    put(tmp_path, "n.parquet", i=pa.array([2**31 - 1], pa.int32()))
    for e in ("i + 1", "i * 2", "i / 0", "i % 0"):
        with pytest.raises(Exception, match="(?i)overflow|zero"):
            engine.sql(f"select {e} from read_files('n.parquet')").collect()


def test_division_of_floats(engine, tmp_path):
    xs = [None, 0.0, 1.0, -1.0, math.nan, math.inf, -math.inf, 7.5]
    pairs = [(a, b) for a in xs for b in xs]
    for kind, np_kind in ((pa.float32(), np.float32), (pa.float64(), np.float64)):
        put(tmp_path, "f.parquet", i=range(len(pairs)), a=pa.array([p[0] for p in pairs], kind), b=pa.array([p[1] for p in pairs], kind))
        got = values(engine.sql("select a / b as q, a % b as r from read_files('f.parquet') order by i"))
        for (a, b), (q, r) in zip(pairs, got, strict=True):
            if a is None or b is None:
                assert q is None and r is None
                continue
            with np.errstate(all="ignore"):
                for have, want in ((q, np_kind(a) / np_kind(b)), (r, np.fmod(np_kind(a), np_kind(b)))):
                    assert (math.isnan(have) and math.isnan(want)) or have == want, (a, b, have, want)


def test_a_zero_divisor_has_a_sign(engine, tmp_path):
    xs = [None, 0.0, -0.0, 1.0, -1.0, math.nan, math.inf, -math.inf]
    for kind in (pa.float32(), pa.float64()):
        put(tmp_path, "z.parquet", i=range(len(xs)), a=pa.array(xs, kind), n=pa.array([-3, -1, 0, 1, 3, None, 2**31 - 1, -(2**31)], pa.int32()))
        got = values(engine.sql("select a / (a * 0) as p, a / -0.0 as q, 1.0 / -0.0 as r, n / (a * 0) as s, n / -(n * 0.0) as t, a % -0.0 as u from read_files('z.parquet') order by i"))
        z = f"'{tmp_path}/z.parquet'"
        want = duckdb.sql(f"select a / (a * 0), a / '-0.0'::FLOAT, 1::FLOAT / '-0.0'::FLOAT, n::FLOAT / (a * 0), n::FLOAT / -(n::FLOAT * 0), a % '-0.0'::FLOAT from {z} order by i").fetchall()
        assert repr(got) == repr(want), kind
        assert got[3][1] == -math.inf and got[4][1] == math.inf and got[4][3] == -math.inf and got[3][2] == -math.inf


def test_nulls_and_order(engine, tmp_path):
    put(tmp_path, "o.parquet", k=pa.array([3, None, 1, 2, None], pa.int32()), v=[1, 2, 3, 4, 5])
    assert [r[0] for r in values(engine.sql("select v from read_files('o.parquet') order by k, v desc"))] == [5, 2, 3, 4, 1]
    assert [r[0] for r in values(engine.sql("select v from read_files('o.parquet') order by k desc, v"))] == [2, 5, 1, 4, 3]
    assert [r[0] for r in values(engine.sql("select v from read_files('o.parquet') where k > 1 or k = 1 order by v limit 2 offset 1"))] == [3, 4]
    assert values(engine.sql("select 1 as one from read_files('o.parquet') where k < 0 order by k")) == []


def test_every_type_passes_through(engine, tmp_path):
    put(tmp_path, "t.parquet", a=pa.array([[1, 2]]), b=pa.array([{"x": 1}]), c=pa.array([[("k", 1)]], pa.map_(pa.string(), pa.int64())), d=pa.array([datetime.date(2020, 1, 2)]), e=pa.array([b"x"]), f=pa.array([1], pa.decimal128(10, 2)), g=pa.array([1], pa.uint16()))
    df = engine.sql("select * from read_files('t.parquet') where d = d and f + f = f")
    assert df.columns == list("abcdefg") and df.count() == 0
    assert engine.sql("select * from read_files('t.parquet') where d = d").count() == 1


def test_globs(engine, tmp_path):
    for name in ("a/1.parquet", "a/b/2.parquet", "a/b/c/3.parquet", "a/x1.parquet", "a/x[y.parquet", "a/_hidden/4.parquet"):
        put(tmp_path, name, n=[name])
    found = lambda g: sorted(r[0] for r in values(engine.sql(f"select n from read_files('{g}')")))
    assert found("a/*.parquet") == ["a/1.parquet", "a/b/2.parquet", "a/b/c/3.parquet", "a/x1.parquet", "a/x[y.parquet"]
    assert found("a/?.parquet") == ["a/1.parquet"]
    assert found("**/3.parquet") == ["a/b/c/3.parquet"]
    assert found("a/[x][0-9].parquet") == ["a/x1.parquet"] and found("a/x[!0-9]y.parquet") == ["a/x[y.parquet"]
    assert found("a/{1,b/2}.parquet") == ["a/1.parquet", "a/b/2.parquet"]
    assert found("a/b/c/3.parquet") == ["a/b/c/3.parquet"]
    assert values(engine.sql("select anything from read_files('none/*.parquet') where x > 1 order by y")) == []


def test_a_folder_stands_for_its_files(engine, tmp_path):
    """As tables that Spark has written do."""
    for k in range(3):
        put(tmp_path, f"vectors.parquet/part-{k}.parquet", n=[k], v=[[k + 0.5, 1.0]])
    put(tmp_path, "vectors.parquet/more/part-3.parquet", n=[3], v=[[3.5]])
    put(tmp_path, "one/one.parquet/part-0.parquet", n=[7], v=[[7.5]])
    (tmp_path / "vectors.parquet/_SUCCESS").touch()
    (tmp_path / "empty.parquet").mkdir()
    found = lambda g: sorted(r[0] for r in values(engine.sql(f"select n from read_files('{g}')")))
    for glob in ("vectors.parquet", "vectors.parquet/", "/vectors.parquet", "{vectors,nothing}.parquet/", "*ectors.parquet", "v?ctors.parquet"):
        assert found(glob) == [0, 1, 2, 3], glob
    assert found("one/one.parquet") == found("*/one.parquet") == [7] and found("vectors.parquet/more") == [3]
    assert values(engine.sql("select * from read_files('vectors.parquet') where n = 3")) == [(3, [3.5])]
    for glob in ("empty.parquet", "vectors", "vectors.parque?/x", "{v,vectors}"):
        assert engine.sql(f"select * from read_files('{glob}')").columns == []


@pytest.mark.parametrize("call", ["read_files()", "read_files(x)", "read_files(1)", "read_files('a', 'b')", "read_files('a', conn => 'b')", "read_files('a', connection => 1)", "read_files('a', connection => 'b', c => 'd')", "read_files('a[')", "read_files('{a')"])
def test_wrong_arguments(engine, call):
    with pytest.raises(errors.FunctionArgumentError):
        engine.sql(f"select * from {call}")


def test_unknown_names(engine):
    with pytest.raises(errors.UnknownFunctionError):
        engine.sql("select * from other_files('a')")
    with pytest.raises(errors.ConnectionConfigError):
        engine.sql("select * from read_files('a', connection => 'nowhere')")


def test_tables_and_table_functions(engine):
    engine.spark.range(5).createOrReplaceTempView("five")
    assert [r[0] for r in values(engine.sql("select id from five where id > 2"))] == [3, 4]
    engine.add_table_function(TableFunction("upto", lambda a: int(a[0].value.text), lambda e, n: e.spark.range(n)))
    assert engine.sql("select id from upto(4)").count() == 4
    with pytest.raises(errors.EngineError):
        engine.add_table_function(TableFunction("upto", lambda a: None, lambda e, n: None))


def test_spark_sql(cost):
    got = values(cost.spark_sql("select good, sum(cost) s from read_files('cost.parquet') c where text is not null or text = 'read_files(1)' group by good order by s;"))
    assert got == [(True, 40), (False, 60)]


def test_spark_sql_index_beyond_the_end(engine, tmp_path):
    rows = [[[1, 2], [[5], []], "p,q", 3], [[], [], "", 1], [None, None, None, 0]]
    put(tmp_path, "a.parquet", k=range(3), a=[r[0] for r in rows], b=[r[1] for r in rows], s=[r[2] for r in rows], n=[r[3] for r in rows])
    t = "read_files('a.parquet')"
    for what, want in {
        "a[0]": [1, None, None], "a[n - 2]": [2, None, None], "t.a [ 0 ]": [1, None, None], "(a)[1] + 1": [3, None, None], "b[0][0]": [5, None, None], "b[1][0]": [None] * 3, "a[a[0] + a[7]]": [None] * 3, "a[a[0]]": [2, None, None],
        "split(s, ',')[1]": ["q", None, None], "split(s, ',')[1] is null": [False, True, True], "transform(b, x -> x[0])[0]": [5, None, None], "array(1, 2)[n]": [None, 2, 1], "case when (a)[0] = 1 then a[9] else a[0] end": [None] * 3,
        "map('x', 1)['x']": [1] * 3, "map(1, a)[1][0]": [1, None, None], "map('x', a[5], 'y', 7)['y']": [7] * 3, "named_struct('v', a).v[0]": [1, None, None], "array(named_struct('v', n))[2].v": [None] * 3, "array(named_struct('v', n))['v'][5]": [None] * 3, """array(named_struct('v', n))["v"] is null or a[5] = 1""": [None] * 3,
        "'a[0]' || `s`": ["a[0]p,q", "a[0]", None], "map(1, 2)[1] + a[0]": [3, None, None],
    }.items():
        assert [r[0] for r in values(engine.spark_sql(f"select {what} as x from {t} t order by k -- a[0]"))] == want, what
    df = engine.spark_sql(f"select a[0], a[1] as y, map(1, n)[1] from {t} order by a[0] nulls last, k;")
    assert df.columns == ["a[0]", "y", "map(1, n)[1]"] and values(df) == [(1, 2, 3), (None, None, 1), (None, None, 0)]
    grouped = engine.spark_sql(f"with g as (select a[0] first, count(*) n from {t} group by a[0]) select n, first from g order by first")
    assert values(grouped) == [(2, None), (1, 1)]
    assert values(engine.spark_sql(f"select k from {t} where (select max(a[1]) from {t}) = 2 and b[0] is null order by k")) == [(1,), (2,)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):  # all else is as Spark has it
        engine.spark_sql(f"select a[0], 1 / (n - 1) from {t}").collect()
    with pytest.raises(AnalysisException):
        engine.spark_sql(f"select n[0] from {t}")
    engine.spark_sql("create table tidewater_once using parquet as select array(1)[0] as x")
    engine.spark_sql("insert into tidewater_once select array(2)[0]")
    assert sorted(values(engine.spark_sql("select x from tidewater_once"))) == [(1,), (2,)]
    engine.spark_sql("drop table tidewater_once")


def test_random_expressions_against_duckdb(engine, tmp_path):
    rng = random.Random(7)
    n = 200
    put(tmp_path, "r.parquet", i=pa.array([rng.choice([None, *range(-9, 10)]) for _ in range(n)], pa.int32()), d=pa.array([rng.choice([None, rng.uniform(-5, 5)]) for _ in range(n)]), k=range(n))
    view = duckdb.connect()
    view.sql(f"create view r as select * from '{tmp_path}/r.parquet'")

    def number(depth):
        if depth == 0:
            return rng.choice([("i", "i"), ("d", "d"), (f"{rng.randrange(1, 9)}",) * 2, ((x := f"{rng.randrange(9)}.5"), f"{x}::FLOAT")])
        (a, b), (c, d), op = number(depth - 1), number(depth - 1), rng.choice("+-*")
        return f"({a} {op} {c})", f"({b} {op} {d})"

    def test(depth):
        if depth == 0:
            (a, b), (c, d), op = number(1), number(1), rng.choice(["<", "<=", ">", ">=", "=", "<>"])
            return f"{a} {op} {c}", f"{b} {op} {d}"
        (a, b), (c, d), op = test(depth - 1), test(depth - 1), rng.choice(["and", "or"])
        return f"({a} {op} not {c})", f"({b} {op} not {d})"

    for _ in range(25):
        (x, y), (p, q) = number(2), test(1)
        ours = values(engine.sql(f"select k, {x} as x from read_files('r.parquet') where {p}"))
        theirs = view.sql(f"select k, {y} as x from r where {q}").fetchall()
        assert sorted(ours) == sorted(theirs), (x, p)


def test_pushdown_and_pruning(cost):
    plan = cost.sql("select text from read_files('cost.parquet') where cost > 20")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(cost,20)" in plan and "other" not in plan


def test_plans_of_order_and_limit(cost):
    plan = lambda text: cost.sql(text)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(cost" in plan("select text from read_files('cost.parquet') order by cost desc")
    top = plan("select text from read_files('cost.parquet') order by cost desc limit 3")
    assert "TakeOrderedAndProject" in top and "Exchange" not in top
    scan = plan("select cost / 2 as half from read_files('cost.parquet') where text = 'world'")
    assert "EqualTo(text,world)" in scan and "ReadSchema: struct<cost:int,text:string>" in scan and "Exchange" not in scan


def test_nulls_and_predicates(engine, tmp_path):
    put(tmp_path, "n.parquet", k=pa.array([1, 2, 3, None], pa.int32()), s=["ab", None, "Abc", ""], b=[True, None, False, None], f=pa.array([1.5, None, -2.5, 0.0], pa.float32()), d=[datetime.date(2020, 1, 1), None, datetime.date(2021, 5, 5), None])
    q = lambda e: [r[0] for r in values(engine.sql(f"select {e} as x from read_files('n.parquet')"))]
    assert q("k is null") == [False, False, False, True] and q("s is not null") == [True, False, True, True]
    assert q("k in (1, 3)") == [True, False, True, None] and q("k in (1, null)") == [True, None, None, None] and q("k not in (2)") == [True, False, True, None]
    assert q("k between 2 and 3") == [False, True, True, None] and q("s like 'a%'") == [True, None, False, False] and q("s ilike 'a_'") == [True, None, False, False]
    assert q("s <=> null") == [False, True, False, False] and q("s = null") == [None] * 4 and q("b xor true") == [False, None, True, None]
    assert q("s || '!'") == ["ab!", None, "Abc!", "!"] and q("k | 4") == [5, 6, 7, None] and q("k ^ 1") == [0, 3, 2, None]
    assert q("case when k > 1 then 'x' end") == [None, "x", "x", None] and q("case k when 1 then 1.5 else k end") == [1.5, 2.0, 3.0, None]
    assert q("coalesce(k, 0)") == [1, 2, 3, 0] and q("nullif(k, 2)") == [1, None, 3, None] and q("length(s)") == [2, None, 3, 0] and q("substr(s, 2)") == ["b", None, "bc", ""]
    assert q("cast(k as varchar)") == ["1", "2", "3", None] and q("cast(f as int)") == [1, None, -2, 0] and q("floor(f)") == [1.0, None, -3.0, 0.0] and q("round(f)") == [2.0, None, -3.0, 0.0]
    assert q("d > date '2020-06-01'") == [False, None, True, None] and q("d < timestamp '2020-01-01 00:00:01'") == [True, None, False, None]
    assert values(engine.sql("select k from read_files('n.parquet') where b is null order by k desc")) == [(None,), (2,)]
    for e in ("k || 's'", "f & 1", "k in ('x')", "k like '1'", "upper(k)", "abs(s)", "case when s then 1 end", "case when b then 1 else 'x' end", "cast(k as money)", "nullif(k)", "cast(k as decimal(50, 2))"):
        with pytest.raises(errors.CoercionError):
            engine.sql(f"select {e} as x from read_files('n.parquet')")


def test_cancelled_before_it_starts(engine, tmp_path):
    put(tmp_path, "c.parquet", a=[1, 2, 3])
    from tidewater.engine import QueryHandle, Status

    handle = QueryHandle(engine, "queued", "select")
    handle.cancel()
    thread = threading.Thread(target=handle._run, args=(engine.sql("select * from read_files('c.parquet')"),))
    thread.start()
    thread.join()
    assert handle.status is Status.CANCELLED and handle.result is None and handle.wait(1) is Status.CANCELLED
    done = engine.run("select * from read_files('c.parquet')")
    engine.release(done.id)
    with pytest.raises(errors.QueryNotFoundError):
        engine.query(done.id)
