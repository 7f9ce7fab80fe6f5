"""A parsed statement to a DataFrame. Filter, then order, then projection; Catalyst does the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ColumnNotFoundError, UnknownTableError
from .ir import Item, Name, Select, Star, Table
from .lower import Scope, lower, predicate


def source_of(engine, select: Select) -> DataFrame:
    source = select.source
    if isinstance(source, Table):
        name = "`" + source.name.replace("`", "``") + "`"
        if not engine.spark.catalog.tableExists(name):
            raise UnknownTableError(f"no table {source.name}")
        return engine.spark.table(name)
    function = engine.functions.get(source.function)
    return function.build(engine, function.validate(source.arguments))


def project(select: Select, df: DataFrame, scope: Scope) -> DataFrame:
    """Names: an alias; a bare column's own name; else unnamed_k, where k counts the expressions without an alias before it,
    bare columns too."""
    columns, k = [], 0
    for item in select.items:
        if isinstance(item, Star):
            if item.alias is not None and item.alias != scope.alias:
                raise ColumnNotFoundError(f"no source {item.alias}")
            columns += [scope.find((name,)).column for name in dict.fromkeys(scope.schema.names)]
            continue
        assert isinstance(item, Item)
        column = lower(item.expr, scope).column
        if item.alias is not None:
            columns.append(column.alias(item.alias))
            continue
        bare = isinstance(item.expr, Name) and len(item.expr.parts) == 1
        columns.append(column.alias(item.expr.parts[0] if bare else f"unnamed_{k}"))
        k += 1
    return df.select(*columns)


def plan(engine, select: Select, scan_order: bool = False) -> DataFrame:
    """``scan_order``: a query over files without ORDER BY gives its rows by file and position in it, at the price of a sort."""
    df = source_of(engine, select)
    if not df.columns:  # no file matched: there is nothing to resolve names against
        return df
    scope = Scope(df.schema, select.source.alias, engine.strict_types)
    if select.where is not None:
        df = df.where(predicate(select.where, scope))
    if select.order_by:
        keys = [lower(key.expr, scope).column for key in select.order_by]
        df = df.orderBy(*[c.asc_nulls_first() if key.ascending else c.desc_nulls_first() for c, key in zip(keys, select.order_by, strict=True)])
    elif scan_order and not isinstance(select.source, Table):
        df = df.orderBy(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    if select.offset:
        df = df.offset(select.offset)
    if select.limit is not None:
        df = df.limit(select.limit)
    return project(select, df, scope)
