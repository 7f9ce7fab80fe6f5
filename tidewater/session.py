"""Sessions with the settings the dialect counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Exact-case names, errors on overflow, one time zone for all machines.
SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def create_session(app: str = "tidewater", master: str | None = None, **conf: str) -> SparkSession:
    """A session for the engine; further settings by keyword, with _ for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
