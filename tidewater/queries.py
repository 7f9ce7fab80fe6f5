"""The engine's registered queries: dialect SQL over the tables' files, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators.ranges import range_column
from .operators.results import Cursor, Result, write_result

LINE = "read_files('lineitem.parquet')"
ORDERS = "read_files('orders.parquet')"

#: name: (dialect, DuckDB). The flagship is the first.
DIALECT: dict[str, tuple[str, str]] = {
    "flagship": (
        f"""select l_orderkey, l_returnflag, l_linenumber + 10.0 as line_plus_10, (l_extendedprice + 10) / 100 as price,
            1.0 / l_linenumber as inverse, 1.0 / (l_linenumber * l_linenumber) as inverse_square, l_linenumber * l_linenumber as square
            from {LINE} where l_linenumber > 2 + 0.0""",
        """select l_orderkey, l_returnflag, l_linenumber + 10.0::FLOAT as line_plus_10, (l_extendedprice + 10) / 100 as price,
            1.0::FLOAT / l_linenumber as inverse, 1.0::FLOAT / (l_linenumber * l_linenumber) as inverse_square, l_linenumber * l_linenumber as square
            from lineitem where l_linenumber > 2""",
    ),
    "scan_star": ("select * from read_files('region.parquet')", "select * from region"),
    "scan_alias_qualified": ("select n.n_name as n_name, n.n_regionkey as n_regionkey from read_files('nation.parquet') n where n.n_regionkey = 1", "select n_name, n_regionkey from nation where n_regionkey = 1"),
    "scan_alias_star": ("select n.* from read_files('nation.parquet') as n", "select * from nation"),
    "glob_question": ("select * from read_files('r?gion*')", "select * from region"),
    "glob_braces": ("select * from read_files('{region,nothing}.parquet')", "select * from region"),
    "named_connection": ("select n_name from read_files('*ation.parquet', connection => 'tables')", "select n_name from nation"),
    "project_columns": (f"select o_orderkey, o_orderstatus from {ORDERS}", "select o_orderkey, o_orderstatus from orders"),
    "project_unnamed": (f"select o_orderkey, o_orderkey + 1, o_orderkey * 2 from {ORDERS}", "select o_orderkey, o_orderkey + 1 as unnamed_1, o_orderkey * 2 as unnamed_2 from orders"),
    "project_alias": (f"select o_orderkey as k, o_custkey + o_orderkey as both from {ORDERS}", "select o_orderkey as k, o_custkey + o_orderkey as both from orders"),
    "arith_int": (
        f"select l_linenumber * 3 + 1 as a, l_linenumber % 2 as b, l_linenumber / 2 as c, -l_linenumber / 2 as d from {LINE}",
        "select l_linenumber * 3 + 1 as a, l_linenumber % 2 as b, l_linenumber // 2 as c, -l_linenumber // 2 as d from lineitem",
    ),
    "arith_float32": (f"select l_linenumber + 10.0 as a, 1.0 / l_linenumber as b, 7.5 % l_linenumber as c from {LINE}", "select l_linenumber + 10.0::FLOAT as a, 1.0::FLOAT / l_linenumber as b, 7.5::FLOAT % l_linenumber as c from lineitem"),
    "arith_double": (f"select (l_extendedprice + 10) / 100 as a, l_extendedprice * l_discount as b from {LINE}", "select (l_extendedprice + 10) / 100 as a, l_extendedprice * l_discount as b from lineitem"),
    "arith_divide_by_zero": (f"select l_orderkey, l_linenumber / (l_discount * 0) as a from {LINE}", "select l_orderkey, l_linenumber / (l_discount * 0) as a from lineitem"),
    "arith_minus": (f"select l_extendedprice - l_discount as a, -l_tax as b, -5 + l_linenumber as c from {LINE}", "select l_extendedprice - l_discount as a, -l_tax as b, -5 + l_linenumber as c from lineitem"),
    "bigint_float_widened": (f"select l_orderkey + 0.5 as a from {LINE}", "select l_orderkey::DOUBLE + 0.5::DOUBLE as a from lineitem"),
    "filter_lt": (f"select l_orderkey, l_quantity from {LINE} where l_quantity < 10", "select l_orderkey, l_quantity from lineitem where l_quantity < 10"),
    "filter_le": (f"select l_orderkey, l_quantity from {LINE} where l_quantity <= 10", "select l_orderkey, l_quantity from lineitem where l_quantity <= 10"),
    "filter_gt": (f"select l_orderkey, l_quantity from {LINE} where l_quantity > 40", "select l_orderkey, l_quantity from lineitem where l_quantity > 40"),
    "filter_ge": (f"select l_orderkey, l_quantity from {LINE} where l_quantity >= 40", "select l_orderkey, l_quantity from lineitem where l_quantity >= 40"),
    "filter_eq": ("select p_partkey from read_files('part.parquet') where p_size = 15", "select p_partkey from part where p_size = 15"),
    "filter_ne": ("select p_partkey from read_files('part.parquet') where p_size <> 15 and p_size != 16", "select p_partkey from part where p_size <> 15 and p_size <> 16"),
    "filter_string_eq": (f"select * from {ORDERS} where o_orderstatus = 'F'", "select * from orders where o_orderstatus = 'F'"),
    "filter_string_ne": (f"select o_orderkey from {ORDERS} where o_orderstatus <> 'F'", "select o_orderkey from orders where o_orderstatus <> 'F'"),
    "filter_string_lt": ("select c_custkey from read_files('customer.parquet') where c_mktsegment < 'C'", "select c_custkey from customer where c_mktsegment < 'C'"),
    "filter_modulo": (f"select * from {ORDERS} where o_orderkey % 2 = 0", "select * from orders where o_orderkey % 2 = 0"),
    "filter_and_or": (f"select l_orderkey, l_linenumber from {LINE} where (l_quantity < 5 and l_discount > 0) or l_linenumber = 7", "select l_orderkey, l_linenumber from lineitem where (l_quantity < 5 and l_discount > 0) or l_linenumber = 7"),
    "filter_not": (f"select l_orderkey, l_linenumber from {LINE} where not (l_quantity < 45 or l_linenumber = 1)", "select l_orderkey, l_linenumber from lineitem where not (l_quantity < 45 or l_linenumber = 1)"),
    "filter_number_as_truth": (f"select l_orderkey, l_linenumber from {LINE} where l_linenumber % 2 and l_quantity < 9", "select l_orderkey, l_linenumber from lineitem where (l_linenumber % 2) <> 0 and l_quantity < 9"),
    "filter_folded": (f"select l_orderkey, l_linenumber from {LINE} where l_linenumber > 2 + 0.0", "select l_orderkey, l_linenumber from lineitem where l_linenumber > 2"),
    "filter_true": ("select * from read_files('supplier.parquet') where true", "select * from supplier"),
    "filter_float_literal": (f"select l_orderkey, l_linenumber from {LINE} where l_discount > 0.05", "select l_orderkey, l_linenumber from lineitem where l_discount > 0.05::FLOAT::DOUBLE"),
    "constant_column": ("select 1 as one, 'x' as x, true as t, r_regionkey from read_files('region.parquet')", "select 1 as one, 'x' as x, true as t, r_regionkey from region"),
    "order_by_desc": (f"select * from {ORDERS} order by o_totalprice desc", "select * from orders order by o_totalprice desc nulls first"),
    "order_by_expressions": (f"select o_orderkey, o_custkey from {ORDERS} order by o_custkey % 10, o_totalprice desc", "select o_orderkey, o_custkey from orders order by o_custkey % 10, o_totalprice desc"),
    "order_by_hidden": (f"select o_orderkey from {ORDERS} order by o_totalprice", "select o_orderkey from orders order by o_totalprice"),
    "order_limit": (f"select o_orderkey, o_totalprice from {ORDERS} order by o_totalprice desc, o_orderkey limit 10", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10"),
    "order_limit_offset": (f"select o_orderkey from {ORDERS} order by o_orderkey limit 10 offset 25", "select o_orderkey from orders order by o_orderkey limit 10 offset 25"),
    "timestamps_pass": ("select event_id, ts, props from read_files('events.parquet') where value > 50", "select event_id, ts, props from events where value > 50"),
    "filter_in": ("select p_partkey, p_size from read_files('part.parquet') where p_size in (1, 5, 15) or p_brand not in ('Brand#11', 'Brand#12')", "select p_partkey, p_size from part where p_size in (1, 5, 15) or p_brand not in ('Brand#11', 'Brand#12')"),
    "filter_between": (f"select l_orderkey, l_linenumber from {LINE} where l_quantity between 10 and 20 and l_linenumber not between 2 and 4", "select l_orderkey, l_linenumber from lineitem where l_quantity between 10 and 20 and l_linenumber not between 2 and 4"),
    "filter_like": ("select p_partkey, p_name from read_files('part.parquet') where p_name like '%a_e%' and p_type not like 'S%'", "select p_partkey, p_name from part where p_name like '%a_e%' and p_type not like 'S%'"),
    "filter_ilike": ("select c_custkey from read_files('customer.parquet') where c_mktsegment ilike 'b%g'", "select c_custkey from customer where c_mktsegment ilike 'b%g'"),
    "filter_is_null": (f"select o_orderkey from {ORDERS} where nullif(o_orderstatus, 'F') is null and o_custkey is not null", "select o_orderkey from orders where nullif(o_orderstatus, 'F') is null and o_custkey is not null"),
    "filter_null_safe": (f"select o_orderkey from {ORDERS} where nullif(o_orderstatus, 'F') <=> nullif(o_orderstatus, 'O')", "select o_orderkey from orders where nullif(o_orderstatus, 'F') is not distinct from nullif(o_orderstatus, 'O')"),
    "filter_xor": (f"select l_orderkey, l_linenumber from {LINE} where l_quantity < 10 xor l_discount > 0.05", "select l_orderkey, l_linenumber from lineitem where (l_quantity < 10) <> (l_discount > 0.05::FLOAT::DOUBLE)"),
    "filter_timestamp": (f"select l_orderkey, l_linenumber, l_shipdate from {LINE} where l_shipdate >= date '1995-01-01' and l_shipdate < timestamp '1996-07-01 12:00:00'", "select l_orderkey, l_linenumber, l_shipdate from lineitem where l_shipdate >= date '1995-01-01' and l_shipdate < timestamp '1996-07-01 12:00:00'"),
    "case_when": (
        f"select l_orderkey, l_linenumber, case when l_quantity < 10 then 'few' when l_quantity < 30 then 'some' else 'many' end as size, case l_linenumber when 1 then 10 when 2 then 20 end as code from {LINE}",
        "select l_orderkey, l_linenumber, case when l_quantity < 10 then 'few' when l_quantity < 30 then 'some' else 'many' end as size, case l_linenumber when 1 then 10 when 2 then 20 end as code from lineitem",
    ),
    "case_null_filled": (
        f"select o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'finished') as status, case when o_orderstatus = 'P' then null else o_custkey end as customer from {ORDERS}",
        "select o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'finished') as status, case when o_orderstatus = 'P' then null else o_custkey end as customer from orders",
    ),
    "cast_types": (
        f"select cast(l_orderkey as varchar) as k, cast(l_linenumber as double) / 2 as half, cast(l_quantity as decimal(18, 2)) as quantity, cast(l_linenumber as bigint) as n, cast(l_shipdate as date) as day from {LINE}",
        "select l_orderkey::VARCHAR as k, l_linenumber::DOUBLE / 2 as half, l_quantity::DECIMAL(18, 2) as quantity, l_linenumber::BIGINT as n, l_shipdate::DATE as day from lineitem",
    ),
    "concat_strings": ("select c_custkey, c_name || ' / ' || c_mktsegment as both from read_files('customer.parquet')", "select c_custkey, c_name || ' / ' || c_mktsegment as both from customer"),
    "bitwise": (f"select l_linenumber & 3 as a, l_linenumber | 8 as b, l_linenumber ^ 5 as c from {LINE}", "select l_linenumber & 3 as a, l_linenumber | 8 as b, xor(l_linenumber, 5) as c from lineitem"),
    "scalar_functions": (
        "select p_partkey, upper(p_brand) as up, lower(p_type) as low, length(p_name) as n, substr(p_name, 2, 3) as part, abs(3 - p_size) as off, floor(p_retailprice) as whole, ceil(p_retailprice) as above, trim(concat(' ', p_brand, ' ')) as trimmed from read_files('part.parquet')",
        "select p_partkey, upper(p_brand) as up, lower(p_type) as low, length(p_name)::INTEGER as n, substr(p_name, 2, 3) as part, abs(3 - p_size) as off, floor(p_retailprice) as whole, ceil(p_retailprice) as above, trim(concat(' ', p_brand, ' ')) as trimmed from part",
    ),
    "nested_pass": ("select * from read_files('embeddings.parquet')", ""),
}

#: Spark's own SQL over read_files: what the dialect leaves out.
PASSED_ON: dict[str, tuple[str, str]] = {
    "spark_group_by": (
        f"select l_returnflag, l_linestatus, sum(cast(l_quantity as decimal(18, 2))) as quantity, count(*) as n from {LINE} group by l_returnflag, l_linestatus having count(*) > 10",
        "select l_returnflag, l_linestatus, sum(l_quantity::decimal(18, 2)) as quantity, count(*) as n from lineitem group by l_returnflag, l_linestatus having count(*) > 10",
    ),
    "spark_join": (
        f"select o.o_orderkey, c.c_name, n.n_name from {ORDERS} o join read_files('customer.parquet') c on o.o_custkey = c.c_custkey join read_files('nation.parquet') n on c.c_nationkey = n.n_nationkey where n.n_regionkey = 2",
        "select o.o_orderkey, c.c_name, n.n_name from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey where n.n_regionkey = 2",
    ),
    "spark_window": (
        f"select o_orderkey, place from (select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from {ORDERS}) where place <= 3",
        "select o_orderkey, place::INTEGER as place from (select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) where place <= 3",
    ),
    "spark_union_distinct": (
        "select n_regionkey as k from read_files('nation.parquet') union select r_regionkey from read_files('region.parquet')",
        "select n_regionkey as k from nation union select r_regionkey from region",
    ),
    "spark_left_join": (
        f"select c.c_custkey, o.o_orderkey from read_files('customer.parquet') c left join (select * from {ORDERS} where o_orderstatus = 'P') o on o.o_custkey = c.c_custkey",
        "select c.c_custkey, o.o_orderkey from customer c left join (select * from orders where o_orderstatus = 'P') o on o.o_custkey = c.c_custkey",
    ),
    "spark_full_join": (
        "select n.n_name, s.s_suppkey from (select * from read_files('nation.parquet') where n_nationkey < 20) n full join (select * from read_files('supplier.parquet') where s_nationkey > 4) s on n.n_nationkey = s.s_nationkey",
        "select n.n_name, s.s_suppkey from (select * from nation where n_nationkey < 20) n full join (select * from supplier where s_nationkey > 4) s on n.n_nationkey = s.s_nationkey",
    ),
    "spark_semi_join": (
        f"select c_custkey, c_name from read_files('customer.parquet') c left semi join {ORDERS} o on o.o_custkey = c.c_custkey and o.o_totalprice > 300000",
        "select c_custkey, c_name from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 300000)",
    ),
    "spark_anti_join": (
        f"select c_custkey from read_files('customer.parquet') c where not exists (select 1 from {ORDERS} o where o.o_custkey = c.c_custkey)",
        "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)",
    ),
    "spark_rollup": (
        f"select l_returnflag, l_linestatus, count(*) as n from {LINE} group by rollup (l_returnflag, l_linestatus)",
        "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)",
    ),
    "spark_intersect_except": (
        f"(select c_custkey as k from read_files('customer.parquet') intersect select o_custkey from {ORDERS}) except select s_suppkey from read_files('supplier.parquet')",
        "(select c_custkey as k from customer intersect select o_custkey from orders) except select s_suppkey from supplier",
    ),
    "spark_with_subquery": (
        f"with big as (select o_custkey, count(*) as n from {ORDERS} group by o_custkey) select o_custkey, n from big where n > (select avg(n) from big)",
        "with big as (select o_custkey, count(*) as n from orders group by o_custkey) select o_custkey, n from big where n > (select avg(n) from big)",
    ),
    "spark_functions": (
        f"select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, upper(o_orderpriority) as p, cast(regexp_replace(o_orderpriority, '[^0-9]', '') as int) as level, greatest(o_custkey, o_orderkey) as top from {ORDERS}",
        "select o_orderkey, year(o_orderdate)::INTEGER as y, month(o_orderdate)::INTEGER as m, upper(o_orderpriority) as p, regexp_replace(o_orderpriority, '[^0-9]', '', 'g')::INTEGER as level, greatest(o_custkey, o_orderkey) as top from orders",
    ),
    "spark_nested": (
        "select vec_id, cast(size(embedding) as int) as n, embedding[0] as first, label from read_files('embeddings.parquet')",
        "select vec_id, len(embedding)::INTEGER as n, embedding[1] as first, label from embeddings",
    ),
}


def engine_for(spark: SparkSession, sf_dir: str) -> Engine:
    from .sources.connections import FileConnection

    engine = Engine(spark, root=sf_dir)
    engine.add_connection("tables", FileConnection(sf_dir))
    return engine


def _dialect(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine_for(spark, sf_dir).sql(text)


def _passed_on(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine_for(spark, sf_dir).spark_sql(text)


def _shared(spark: SparkSession) -> str:
    """A folder that driver and executors see, for the results of the paging queries; on a cluster it has to be set."""
    import tempfile

    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidewater-")).rstrip("/")


def stored(spark: SparkSession, sf_dir: str) -> Result:
    import uuid

    df = engine_for(spark, sf_dir).sql(f"select o_orderkey, o_totalprice from {ORDERS} order by o_orderkey")
    path = f"{_shared(spark)}/query_results/{uuid.uuid4().hex}"
    write_result(df, path)
    return Result(spark, path, df.schema)


def _whole_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).frame()


def _page(k: int, limit: int, forward: bool, overflow: bool) -> Callable[[SparkSession, str], DataFrame]:
    """The page at the k-th row of the stored result (from 0 on)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = stored(spark, sf_dir)
        at = Cursor() if k == 0 else result.page(Cursor(), k + 1).offsets[k]
        page = result.page(at, limit, forward, overflow)
        return spark.createDataFrame(page.rows, result.schema)

    return run


def _no_such_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over no files ends well, with neither columns nor rows."""
    handle = engine_for(spark, sf_dir).run("select * from read_files('nothing/*.parquet')")
    found = (handle.status.value, len(handle.result.schema.names), handle.result.count(), handle.page() is None)
    return spark.createDataFrame([found], "status string, n_columns int, n_rows bigint, no_page boolean")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    bounds = [("F", 100000.0), ("O", 100000.0), ("P", 0.0)]
    return orders.groupBy(range_column(["o_orderstatus", "o_totalprice"], bounds).alias("part")).agg(F.count(F.lit(1)).alias("n"))


PROGRAMS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "result_stored": (_whole_result, "select o_orderkey, o_totalprice from orders"),
    "page_forward": (_page(20, 15, True, False), "select o_orderkey, o_totalprice from orders order by o_orderkey limit 15 offset 20"),
    "page_backward": (_page(20, 15, False, False), "select o_orderkey, o_totalprice from orders order by o_orderkey limit 15 offset 6"),
    "page_overflow": (_page(5, 15, False, True), "select o_orderkey, o_totalprice from orders order by o_orderkey limit 15"),
    "no_such_files": (_no_such_files, "select 'complete' as status, 0 as n_columns, 0::BIGINT as n_rows, true as no_page"),
    "range_partition": (
        _ranges,
        """select ((o_orderstatus, o_totalprice) >= ('F', 100000.0::DOUBLE))::INTEGER + ((o_orderstatus, o_totalprice) >= ('O', 100000.0::DOUBLE))::INTEGER + ((o_orderstatus, o_totalprice) >= ('P', 0.0::DOUBLE))::INTEGER as part, count(*) as n
           from orders group by 1""",
    ),
}

QUERIES = {k: _dialect(v[0]) for k, v in DIALECT.items()} | {k: _passed_on(v[0]) for k, v in PASSED_ON.items()} | {k: v[0] for k, v in PROGRAMS.items()}
ORACLE_SQL = {k: v[1] for table in (DIALECT, PASSED_ON, PROGRAMS) for k, v in table.items() if v[1]}
