"""tidewater: a Spark-first query engine over files."""

__version__ = "0.1.0"
