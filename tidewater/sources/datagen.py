"""Sample data sets of three columns: id int, value1 string, value2 float."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SampleSet:
    rows: int
    letters: int
    rows_per_file: int


# The sample sets by name.
SAMPLE_SETS = {
    "simple": SampleSet(100, 8, 33),
    "simple_wide_string": SampleSet(100, 100, 33),
    "large_simple": SampleSet(10_000, 8, 1_000),
    "huge_simple": SampleSet(1_000_000, 8, 10_000),
}


def sample_rows(spark: SparkSession, about: SampleSet, seed: int = 1) -> DataFrame:
    """ids from 0 on, lower-case letters, floats in [0, 100); a function of id and seed, however it is partitioned."""

    def noise(k: int) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(k)), F.lit(1 << 24))

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(about.letters)), lambda k: F.char(97 + F.pmod(F.xxhash64(F.lit(seed), F.col("id"), k), F.lit(26)))), "")
    return spark.range(about.rows).select(F.col("id").cast("int").alias("id"), text.alias("value1"), (noise(0) / (1 << 24) * 100).cast("float").alias("value2"))


def write_sample(spark: SparkSession, folder: str, name: str, seed: int = 1) -> None:
    about = SAMPLE_SETS[name]
    files = -(-about.rows // about.rows_per_file)
    part = F.floor(F.col("id") / about.rows_per_file).cast("int")
    rows = sample_rows(spark, about, seed).withColumn("part", part + 1).repartition(files, "part")
    rows.sortWithinPartitions("part", "id").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/{name}")
