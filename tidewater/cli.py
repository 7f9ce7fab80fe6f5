"""Command line: run one query, run a file of statements, look through results page by page, write sample data."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .engine import Engine
from .errors import EngineError
from .operators.results import Page, Pager
from .plans.tokens import split_statements
from .render import table
from .session import create_session
from .sources.datagen import SAMPLE_SETS, write_sample


def print_page(names: list[str], page: Page | None, out) -> None:
    print(table(names, [tuple(r) for r in page.rows] if page else []), file=out)


def run_statements(engine: Engine, statements: list[str], page_size: int, timeout: float, every_page: bool, out) -> int:
    """One after the other; a statement that fails is reported and the next one runs. Gives the number of failures."""
    failures = 0
    for k, statement in enumerate(statements, 1):
        print(f"-- statement {k} of {len(statements)}\n{statement}", file=out)
        try:
            handle = engine.run(statement, timeout)
            names = handle.result.schema.names
            if every_page:
                some = False
                for page in handle.result.pages(page_size):
                    some = True
                    print_page(names, page, out)
                if not some:
                    print_page(names, None, out)
            else:
                print_page(names, handle.page(limit=page_size), out)
        except EngineError as e:
            failures += 1
            print(f"failed: {type(e).__name__}: {e}", file=out)
    return failures


KEYS = "n next, p previous, f first, l last, <number> rows of a page, s next statement, q quit"


def view(engine: Engine, statements: list[str], page_size: int, timeout: float, keys, out) -> int:
    """Shows each statement's result and moves through it as the lines of ``keys`` say. Gives the number of statements that failed."""
    failures = 0
    for k, statement in enumerate(statements, 1):
        print(f"-- statement {k} of {len(statements)}\n{statement}", file=out)
        try:
            pager = Pager(engine.run(statement, timeout).result)
        except EngineError as e:
            failures += 1
            print(f"failed: {type(e).__name__}: {e}", file=out)
            continue
        names, page = pager.result.schema.names, pager.first(page_size)
        while True:
            print_page(names, page, out)
            print(KEYS, file=out)
            key = keys.readline()
            asked = key.strip().lower()
            if not key or asked == "q":
                return failures
            if asked == "s":
                break
            if asked.isdigit() and int(asked):
                page_size = int(asked)
                page = pager.resize(page_size)
            elif asked in ("f", "l"):
                page = pager.first(page_size) if asked == "f" else pager.last(page_size)
            else:
                page = pager.next(page_size, forward=asked != "p")
    return failures


def main(arguments: list[str] | None = None, out=None, keys=None) -> int:
    out = out or sys.stdout
    top = argparse.ArgumentParser(prog="tidewater", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, what in (("run", "one query"), ("file", "a file of statements"), ("view", "look through the results of a file of statements")):
        c = commands.add_parser(name, help=what)
        c.add_argument("sql", help="the query" if name == "run" else "the file")
        c.add_argument("--config", help="JSON file with the connections; without it, files are under --root")
        c.add_argument("--root", default=".", help="folder of the default connection")
        c.add_argument("--page", type=int, default=20 if name == "run" else 50, help="rows of a page")
        c.add_argument("--all", action="store_true", help="all pages, not just the first")
        c.add_argument("--timeout", type=float, default=60)
    c = commands.add_parser("sample-data", help="write the sample data sets")
    c.add_argument("folder")
    c.add_argument("--set", choices=sorted(SAMPLE_SETS), action="append", help="these only")
    given = top.parse_args(arguments)
    spark = create_session()
    if given.command == "sample-data":
        for name in given.set or SAMPLE_SETS:
            write_sample(spark, str(Path(given.folder).resolve()), name)
            print(f"{given.folder}/{name}", file=out)
        return 0
    engine = Engine.from_file(given.config, spark) if given.config else Engine(spark, root=given.root)
    if given.command == "view":
        return 1 if view(engine, split_statements(Path(given.sql).read_text()), given.page, given.timeout, keys or sys.stdin, out) else 0
    statements = [given.sql] if given.command == "run" else split_statements(Path(given.sql).read_text())
    return 1 if run_statements(engine, statements, given.page, given.timeout, given.all, out) else 0
