"""Paths by pattern. Unlike in Hadoop's own globs, * and ? also match the separator."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import SparkSession

from ..errors import FunctionArgumentError

SPECIAL = "*?[]{}"


def literal_folder(glob: str) -> str:
    """The folder that all matches are in: what comes before the first special character, to the last separator."""
    head = glob
    for k, c in enumerate(glob):
        if c in SPECIAL:
            head = glob[:k]
            break
    return head.rpartition("/")[0]


def glob_regex(glob: str) -> re.Pattern[str]:
    """Matches paths of files that are as the glob says, or that lie in a folder whose path is."""
    out, depth, k = [], 0, 0
    while k < len(glob):
        c = glob[k]
        k += 1
        if c == "*":
            while k < len(glob) and glob[k] == "*":
                k += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", k + (glob[k : k + 1] in ("!", "^")) + 1)
            if end < 0:
                raise FunctionArgumentError(f"a [ without its ] in {glob!r}")
            inner = glob[k:end]
            negated = inner[:1] in ("!", "^")
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]^&~|])", r"\\\1", inner[negated:]) + "]")
            k = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and k < len(glob):
            out.append(re.escape(glob[k]))
            k += 1
        else:
            out.append(re.escape(c))
    if depth:
        raise FunctionArgumentError(f"a {{ without its }} in {glob!r}")
    return re.compile("".join(out) + r"(?:/.*)?\Z", re.S)


def escaped(path: str) -> str:
    """The path, for Spark's readers, which take it for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


@dataclass(frozen=True)
class Matched:
    """Full paths of files, in order; ``folder`` where these are all the files of a folder and those below it."""

    paths: list[str]
    folder: str | None = None


def matching_files(spark: SparkSession, root: str, glob: str) -> Matched:
    """The files under root whose path from there matches, or that of a folder they are in: a table may be a folder of files.
    A file's path without special characters is just looked up. Otherwise Spark lists one folder tree, the one that all matches
    are in, in parallel where it is large; hidden files and those of unfinished writes (names that begin with _ or .) are left out, as in all its scans."""
    relative = glob.strip("/")
    pattern = glob_regex(relative)
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    literal = not any(c in relative for c in SPECIAL + "\\")
    folder = relative if literal else literal_folder(relative)
    start = files.makeQualified(jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/" + folder) if folder else base)
    if not files.exists(start):
        return Matched([])
    if literal and files.getFileStatus(start).isFile():
        return Matched([start.toString()])
    prefix = files.makeQualified(base).toUri().getPath().rstrip("/") + "/"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(escaped(start.toString())).inputFiles()
    out = []
    for url in listed:
        path = unquote(url)
        if literal or pattern.match(urlsplit_path(path)[len(prefix) :]):
            out.append(path)
    return Matched(sorted(out), start.toString() if len(out) == len(listed) else None)


def urlsplit_path(url: str) -> str:
    """What follows the scheme and the authority, if there are any."""
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", url)
    return url[found.end() :] if found else url
