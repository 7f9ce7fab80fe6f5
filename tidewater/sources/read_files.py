"""read_files('<glob>' [, connection => '<name>']): all matching Parquet files of a connection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import FunctionArgumentError
from ..functions.registry import TableFunction
from ..plans.ir import Argument, Literal
from .connections import DEFAULT
from .globs import escaped, glob_regex, matching_files

#: Formats by the ending of the matched files; anything else is read as Parquet.
FORMATS = {"csv": {"header": "true", "inferSchema": "true"}, "json": {}, "orc": {}}


@dataclass(frozen=True)
class ReadFiles:
    glob: str
    connection: str = DEFAULT


def validate(arguments: tuple[Argument, ...]) -> ReadFiles:
    if not 1 <= len(arguments) <= 2:
        raise FunctionArgumentError(f"read_files takes one or two arguments, not {len(arguments)}")
    first = arguments[0]
    if first.name or not isinstance(first.value, Literal) or first.value.kind != "string":
        raise FunctionArgumentError("the first argument of read_files is a path in single quotes")
    glob_regex(first.value.text)
    if len(arguments) == 1:
        return ReadFiles(first.value.text)
    second = arguments[1]
    if second.name != "connection" or not isinstance(second.value, Literal) or second.value.kind != "string":
        raise FunctionArgumentError("the second argument of read_files is connection => '<name>'")
    return ReadFiles(first.value.text, second.value.text)


def build(engine, asked: ReadFiles) -> DataFrame:
    """A scan of the matching files. None matching gives no rows and no columns. Files of different
    schemas are not merged: Spark takes the first file's."""
    connection = engine.connections.use(engine.spark, asked.connection)
    matched = matching_files(engine.spark, connection.url, asked.glob)
    paths = matched.paths
    if not paths:
        return engine.spark.createDataFrame([], T.StructType([]))
    ending = paths[0].rpartition(".")[2].lower()
    # the paths are found already: what Spark's own globs would take for patterns is escaped
    reader = engine.spark.read
    same_ending = all(p.lower().endswith("." + ending) for p in paths)
    paths = [escaped(p) for p in paths]
    if matched.folder and len(paths) > 1:  # one path for Spark to list in parallel, however many files there are
        reader, paths = reader.option("recursiveFileLookup", "true"), [escaped(matched.folder)]
    if ending in FORMATS and same_ending:
        return reader.format(ending).options(**FORMATS[ending]).load(paths)
    return reader.parquet(*paths)


READ_FILES = TableFunction("read_files", validate, build)
