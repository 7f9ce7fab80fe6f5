"""The dialect over files that keep arriving: filter and projection as a Structured Streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..engine import Engine
from ..errors import UnsupportedError
from ..plans.ir import TableCall
from ..plans.lower import Scope, predicate
from ..plans.parser import parse
from ..plans.planner import project
from ..sources.read_files import validate


def stream(engine: Engine, text: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A streaming DataFrame of a statement over read_files('<folder>/<pattern>'). A stream has no order and no end, so
    ORDER BY, LIMIT and OFFSET are rejected; the pattern is the file system's own here."""
    select = parse(text)
    if select.order_by or select.limit is not None or select.offset is not None:
        raise UnsupportedError("a stream has no ORDER BY, LIMIT or OFFSET")
    if not isinstance(select.source, TableCall) or select.source.function != "read_files":
        raise UnsupportedError("a stream reads from read_files")
    asked = validate(select.source.arguments)
    reader = engine.spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(f"{engine.connections.use(engine.spark, asked.connection).url}/{asked.glob.lstrip('/')}")
    scope = Scope(schema, select.source.alias, engine.strict_types)
    if select.where is not None:
        df = df.where(predicate(select.where, scope))
    return project(select, df, scope)


def write_stream(df: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends to Parquet files: every so often (such as '5 seconds'), or all there is now and then ends."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
