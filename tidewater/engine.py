"""The engine: SQL in, a DataFrame or a durable result out."""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass
from enum import Enum

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import QueryFailedError, QueryNotFoundError, UnsupportedError
from .functions.registry import TableFunction, TableFunctions
from .operators.results import START, Cursor, Page, Pager, Result, write_result
from .plans.ir import Select
from .plans.parser import Parser, parse
from .plans.planner import plan
from .plans.tokens import Subscript, subscripts, tokenize, with_get
from .session import create_session
from .sources.connections import Connection, Connections, FileConnection
from .sources.read_files import READ_FILES


class Status(str, Enum):
    QUEUED = "queued"
    RUNNING = "running"
    COMPLETE = "complete"
    ERROR = "error"
    CANCELLED = "cancelled"

    @property
    def final(self) -> bool:
        return self in (Status.COMPLETE, Status.ERROR, Status.CANCELLED)


@dataclass
class QueryHandle:
    """A submitted query. Its result stays where it was written when the session ends."""

    engine: Engine
    id: str
    text: str
    status: Status = Status.QUEUED
    error: str | None = None
    result: Result | None = None

    def __post_init__(self) -> None:
        self._done = threading.Event()
        self._asked = False

    @property
    def tag(self) -> str:
        return f"tidewater-{self.id}"

    def wait(self, timeout: float | None = 60) -> Status:
        """Until the query has ended or the time is over; gives the status then."""
        self._done.wait(timeout)
        return self.status

    def cancel(self) -> None:
        """Ends the query, also one whose first job hasn't started yet."""
        if not self.status.final:
            self._asked = True
            self.engine.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(self.tag)

    def rows(self) -> Result:
        if self.status is not Status.COMPLETE:
            raise QueryFailedError(self.error or f"the query is {self.status.value}")
        return self.result

    def page(self, cursor: Cursor = START, limit: int = 50, forward: bool = True, allow_overflow: bool = False) -> Page | None:
        return self.rows().page(cursor, limit, forward, allow_overflow)

    def pager(self) -> Pager:
        return Pager(self.rows())

    def _run(self, df: DataFrame) -> None:
        spark = self.engine.spark
        spark.sparkContext.setJobGroup(self.tag, self.text, interruptOnCancel=True)
        try:
            if self._asked:
                raise QueryFailedError("the query was cancelled before it started")
            self.status = Status.RUNNING
            path = f"{self.engine.connections.use(spark, self.engine.results).url}/query_results/{self.id}"
            if df.columns:
                write_result(df, path)
                self.result = Result(spark, path, df.schema)
            else:
                self.result = EmptyResult(spark, path, df.schema)
            self.status = Status.COMPLETE
        except Exception as e:
            self.error = str(e)
            self.status = Status.CANCELLED if self._asked else Status.ERROR
        finally:
            self._done.set()


class EmptyResult(Result):
    """Of a query over no files: there are no columns to write."""

    def frame(self, with_position: bool = False) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([]))

    def page(self, cursor: Cursor = START, limit: int = 50, forward: bool = True, allow_overflow: bool = False) -> Page | None:
        return None


class Engine:
    """``strict_types`` makes BIGINT with a decimal literal an error instead of a double. ``results`` names the connection that
    results are written to. ``scan_order`` pages queries without ORDER BY in the order of files."""

    def __init__(self, spark: SparkSession | None = None, root: str | None = None, connections: Connections | None = None, strict_types: bool = False, results: str = "default", scan_order: bool = False):
        self.spark = spark or create_session()
        self.connections = connections or Connections()
        if root is not None:
            self.connections.add("default", FileConnection(root))
        self.functions = TableFunctions()
        self.functions.add(READ_FILES)
        self.strict_types, self.results, self.scan_order = strict_types, results, scan_order
        self._queries: dict[str, QueryHandle] = {}
        self._lock = threading.Lock()

    @classmethod
    def from_file(cls, path: str, spark: SparkSession | None = None, **options) -> Engine:
        return cls(spark, connections=Connections.from_file(path), **options)

    def add_connection(self, name: str, connection: Connection) -> None:
        self.connections.add(name, connection)

    def add_table_function(self, function: TableFunction) -> None:
        self.functions.add(function)

    def parse(self, text: str) -> Select:
        return parse(text)

    def sql(self, text: str) -> DataFrame:
        """One statement of the dialect, lazily."""
        return plan(self, parse(text), self.scan_order)

    def submit(self, text: str) -> QueryHandle:
        """Plans the statement, so that its errors are raised here, and starts it in the background."""
        df = self.sql(text)
        handle = QueryHandle(self, uuid.uuid4().hex, text)
        with self._lock:
            self._queries[handle.id] = handle
        threading.Thread(target=handle._run, args=(df,), name=handle.tag, daemon=True).start()
        return handle

    def query(self, query_id: str) -> QueryHandle:
        with self._lock:
            if query_id not in self._queries:
                raise QueryNotFoundError(f"no query {query_id}")
            return self._queries[query_id]

    def release(self, query_id: str) -> None:
        """Forgets a query that has ended; what it wrote stays."""
        with self._lock:
            if query_id in self._queries and self._queries[query_id].status.final:
                del self._queries[query_id]

    def run(self, text: str, timeout: float | None = 60) -> QueryHandle:
        """Submits, waits, and raises what went wrong."""
        handle = self.submit(text)
        status = handle.wait(timeout)
        if status in (Status.ERROR, Status.CANCELLED):
            raise QueryFailedError(handle.error)
        if not status.final:
            raise QueryFailedError(f"no result within {timeout} seconds")
        return handle

    def spark_sql(self, text: str) -> DataFrame:
        """Any query of Spark's SQL, with its own semantics, in which read_files(...) and other table functions of the
        engine may stand where a table may: joins, aggregates, windows, set operations and functions. An index beyond an
        array's end gives null in queries, but after the operands that subscripts() leaves out."""
        tokens, out, at, k = tokenize(text), [], 0, 0
        while k < len(tokens):
            token = tokens[k]
            called = k + 1 < len(tokens) and tokens[k + 1].is_symbol("(") and token.kind == "word"
            if called and self._knows(token.text):
                depth, end = 0, k + 1
                while end < len(tokens):
                    depth += tokens[end].is_symbol("(") - tokens[end].is_symbol(")")
                    if not depth:
                        break
                    end += 1
                if depth:
                    raise UnsupportedError(f"{token.text} without its )")
                call = Parser(text[token.at : tokens[end].end]).source()
                function = self.functions.get(call.function)
                view = f"tidewater_{uuid.uuid4().hex}"
                function.build(self, function.validate(call.arguments)).createOrReplaceTempView(view)
                out += [text[at : token.at], view]
                at, k = tokens[end].end, end
            k += 1
        out.append(text[at:])
        return self._lenient(re.sub(r";\s*\Z", "", "".join(out)))

    def _lenient(self, text: str) -> DataFrame:
        """Runs the text with get(a, i) for each a[i] in which Spark finds an array: all of them if it takes that, else one by one,
        since a may be a map. What it doesn't take with the same types of columns stays as it is, and so does a command."""
        found = subscripts(text)
        asked = self._analysed(text) if found else None
        if asked is None:
            return self.spark.sql(text)

        def fits(chosen: list[Subscript]) -> bool:
            df = self._analysed(with_get(text, chosen))
            return df is not None and [kind for _, kind in df.dtypes] == [kind for _, kind in asked.dtypes]

        chosen = found if fits(found) else []
        for s in found if not chosen else []:
            if fits([*chosen, s]):
                chosen.append(s)
        df = self.spark.sql(with_get(text, chosen))
        return df if df.columns == asked.columns else df.toDF(*asked.columns)

    def _analysed(self, text: str) -> DataFrame | None:
        """A query, of which nothing runs; none if Spark refuses it or it is a command, which can't stand in parentheses."""
        try:
            return self.spark.sql(f"select * from ({text}\n)")
        except PySparkException:
            return None

    def _knows(self, name: str) -> bool:
        try:
            return bool(self.functions.get(name))
        except Exception:
            return False

    def wait_all(self, timeout: float = 60, poll: float = 0.1) -> None:
        until = time.time() + timeout
        while time.time() < until and not all(q.status.final for q in list(self._queries.values())):
            time.sleep(poll)
