"""Durable results: Parquet files with a position in every row, read back page by page in either direction.

The position is monotonically_increasing_id: the writing partition in the upper bits, the row in the lower 33. It
grows in the order of the result and is a cursor into it. Spark numbers the files by the same partition, so a page
opens only the files it lies in, and of these only the row groups that Parquet's statistics leave.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DuplicateColumnError

POSITION = "_pos"
ROW_BITS = 33
#: In a cursor: the last row of a row group or file, or the last file.
LAST = 2**64 - 1
#: Rows in a file at most, so that a page's file is small.
ROWS_PER_FILE = 1_000_000
#: Files that a page opens at once, at most; it starts with one.
MOST_FILES = 64
PART = re.compile(r"part-(\d+)-[^/]*?(?:\.c|-c)?(\d+)?\.[^/]*\Z")


@dataclass(frozen=True, order=True)
class Cursor:
    file: int = 0
    row_group: int = 0
    row: int = 0

    @classmethod
    def of(cls, position: int) -> Cursor:
        return cls(position >> ROW_BITS, 0, position & (1 << ROW_BITS) - 1)

    @property
    def position(self) -> int:
        row = (1 << ROW_BITS) - 1 if self.row_group > 0 or self.row >= 1 << ROW_BITS else self.row
        return min(self.file, (1 << 63 - ROW_BITS) - 1) << ROW_BITS | row

    def next(self) -> Cursor:
        return Cursor(self.file, self.row_group, self.row + 1)

    def previous(self) -> Cursor | None:
        if self.row:
            return Cursor(self.file, self.row_group, self.row - 1)
        return Cursor(self.file - 1, 0, LAST) if self.file else None


START, END = Cursor(), Cursor(LAST, 0, LAST)


@dataclass(frozen=True)
class Page:
    """Rows in ascending order with their cursors. ``first`` is the row nearest to where the page was asked for."""

    rows: list[Row]
    offsets: list[Cursor]
    first: Cursor


def write_result(df: DataFrame, path: str) -> None:
    names = df.columns
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise DuplicateColumnError(f"the result has several columns named {', '.join(repeated)}; give them aliases")
    if POSITION in names:
        raise DuplicateColumnError(f"{POSITION} is a reserved name")
    df.withColumn(POSITION, F.monotonically_increasing_id()).write.option("maxRecordsPerFile", ROWS_PER_FILE).mode("errorifexists").parquet(path)


class Result:
    """A written result. Its schema is kept, so that pages need no look at footers first."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema
        self._listed: list[tuple[int, int, str]] | None = None

    def frame(self, with_position: bool = False) -> DataFrame:
        df = self._read([self.path])
        return df if with_position else df.drop(POSITION)

    def _read(self, paths: list[str]) -> DataFrame:
        full = T.StructType([*json_copy(self.schema).fields, T.StructField(POSITION, T.LongType())])
        return self.spark.read.schema(full).parquet(*paths)

    def _files(self) -> list[tuple[int, int, str]]:
        """(partition, number within it, path) of all files, in the order of the result; listed once."""
        if self._listed is None:
            found = []
            for path in self._read([self.path]).inputFiles():
                m = PART.search(path)
                found.append((int(m[1]), int(m[2] or 0), path) if m else (0, 0, path))
            self._listed = sorted(found)
        return self._listed

    def _rows(self, position: int, limit: int, forward: bool) -> list[Row]:
        """Up to ``limit`` rows from the position on, in the direction of travel; a few files at a time."""
        files = self._files()
        if forward:
            ahead = [f for p, _, f in files if p >= position >> ROW_BITS]
            inside, order = F.col(POSITION) >= position, F.asc(POSITION)
        else:
            ahead = [f for p, _, f in files if p <= position >> ROW_BITS][::-1]
            inside, order = F.col(POSITION) <= position, F.desc(POSITION)
        rows: list[Row] = []
        k, step = 0, 1
        while k < len(ahead) and len(rows) < limit:
            rows += self._read(ahead[k : k + step]).where(inside).orderBy(order).limit(limit - len(rows)).collect()
            k, step = k + step, min(2 * step, MOST_FILES)
        return rows

    def count(self) -> int:
        return self.frame().count()

    def page(self, cursor: Cursor = START, limit: int = 50, forward: bool = True, allow_overflow: bool = False) -> Page | None:
        """Up to ``limit`` rows from the cursor on, it included; backward, up to it. Cursors between rows or past the end of
        a file lead on to the next row in the direction. With ``allow_overflow`` a backward page that meets the start is filled up with
        the rows after the cursor. None where there are no rows."""
        if limit <= 0:
            return None
        rows = self._rows(cursor.position, limit, forward)
        if not forward:
            rows = rows[::-1]
        if not rows and not (allow_overflow and not forward):
            return None
        nearest = (rows[0] if forward else rows[-1])[POSITION] if rows else None
        if not forward and allow_overflow and len(rows) < limit:
            rows += self._rows(cursor.position + 1, limit - len(rows), True)
        if not rows:
            return None
        first = Cursor.of(rows[0][POSITION] if nearest is None else nearest)
        return Page([Row(**{n: r[n] for n in self.schema.names}) if self.schema.names else Row() for r in rows], [Cursor.of(r[POSITION]) for r in rows], first)

    def pages(self, limit: int = 50, forward: bool = True) -> Iterator[Page]:
        """All pages, from the start on or from the end back."""
        cursor: Cursor | None = START if forward else END
        while cursor is not None and (page := self.page(cursor, limit, forward)):
            yield page
            if len(page.rows) < limit:
                return
            cursor = page.offsets[-1].next() if forward else page.offsets[0].previous()


class Pager:
    """Pages of a window for a viewer that moves up and down and resizes."""

    def __init__(self, result: Result):
        self.result, self.current = result, None

    def first(self, window: int) -> Page | None:
        self.current = self.result.page(START, window, True)
        return self.current

    def last(self, window: int) -> Page | None:
        self.current = self.result.page(END, window, False) or self.current
        return self.current

    def resize(self, window: int) -> Page | None:
        """A window of another size from the first row shown on; near the end, filled up from before it."""
        if self.current is None:
            return self.first(window)
        page = self.result.page(self.current.offsets[0], window, True)
        if page and len(page.rows) < window:
            page = self.result.page(END, window, False) or page
        self.current = page or self.current
        return self.current

    def next(self, window: int, forward: bool = True) -> Page | None:
        """The page after (or before) the current one; at an end the current one stays."""
        if self.current is None:
            return self.first(window)
        at = self.current.offsets[-1].next() if forward else self.current.offsets[0].previous()
        page = self.result.page(at, window, forward, allow_overflow=not forward) if at is not None else None
        self.current = page or self.current
        return self.current


def json_copy(schema: T.StructType) -> T.StructType:
    return T.StructType.fromJson(json.loads(schema.json()))
