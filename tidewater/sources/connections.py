"""Named places that files are read from and results are written to."""

from __future__ import annotations

import json
import posixpath
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from ..errors import ConnectionConfigError


@dataclass(frozen=True)
class FileConnection:
    """A folder of a file system that driver and executors see; a path, or a URL of any file system Spark knows."""

    root: str

    @property
    def url(self) -> str:
        if "://" in self.root:
            return self.root.rstrip("/")
        return "file://" + posixpath.normpath(posixpath.join(str(Path.cwd()), self.root))

    def settings(self) -> dict[str, str]:
        return {}


@dataclass(frozen=True)
class S3Connection:
    """A bucket, or a folder of it, of S3 or a store with its interface."""

    endpoint: str
    access_key_id: str
    secret_access_key: str = field(repr=False)
    bucket: str = ""
    root: str = ""
    region: str = "us-east-1"
    force_path_style: bool = False

    @property
    def url(self) -> str:
        return f"s3a://{self.bucket}/{self.root.strip('/')}".rstrip("/")

    def settings(self) -> dict[str, str]:
        """Settings of this bucket only, so that several stores can be used side by side."""
        prefix = f"fs.s3a.bucket.{self.bucket}."
        return {
            prefix + "endpoint": self.endpoint,
            prefix + "access.key": self.access_key_id,
            prefix + "secret.key": self.secret_access_key,
            prefix + "endpoint.region": self.region,
            prefix + "path.style.access": str(self.force_path_style).lower(),
        }


Connection = FileConnection | S3Connection
DEFAULT = "default"


class Connections:
    """Connections by name. Reads without a name use ``default``."""

    def __init__(self) -> None:
        self._all: dict[str, Connection] = {}

    def add(self, name: str, connection: Connection) -> None:
        if not name or not name.isascii():
            raise ConnectionConfigError(f"a connection's name is ASCII text, not {name!r}")
        if name in self._all:
            raise ConnectionConfigError(f"a connection {name} exists already")
        self._all[name] = connection

    def get(self, name: str = DEFAULT) -> Connection:
        if name not in self._all:
            raise ConnectionConfigError(f"no connection {name}; there are {', '.join(sorted(self._all)) or 'none'}")
        return self._all[name]

    def use(self, spark: SparkSession, name: str = DEFAULT) -> Connection:
        """The connection, with its settings known to the session's file systems."""
        found = self.get(name)
        if found.settings():
            hadoop = spark.sparkContext._jsc.hadoopConfiguration()
            for key, value in found.settings().items():
                hadoop.set(key, value)
        return found

    @classmethod
    def from_file(cls, path: str) -> Connections:
        """From a JSON file: {"connections": [{"name": ..., "connection_type": {"Fs": {...}} or {"S3": {...}}}]}."""
        try:
            listed = json.loads(Path(path).read_text())["connections"]
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise ConnectionConfigError(f"{path} is not a configuration file: {e!r}") from e
        out = cls()
        for entry in listed:
            try:
                ((kind, about),) = entry["connection_type"].items()
                if kind == "Fs":
                    made: Connection = FileConnection(about["root"])
                elif kind == "S3":
                    made = S3Connection(
                        about["endpoint"], about["access_key_id"], about["secret_access_key_id"], about["bucket"],
                        about.get("root", ""), about.get("region", "us-east-1"), bool(about.get("force_path_style")),
                    )
                else:
                    raise ConnectionConfigError(f"no kind of connection {kind}")
                name = entry["name"]
            except (KeyError, TypeError, ValueError, AttributeError) as e:
                raise ConnectionConfigError(f"a connection is wrongly described: {e!r}") from e
            out.add(name, made)
        return out
