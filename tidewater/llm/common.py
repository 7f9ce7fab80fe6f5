"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, as the operators on words define it, for Java's and Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Of texts in ASCII alone, lower does the same, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all run on one machine
    (local masters, as in tests) a temporary one that is set for the session. On a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidewater.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("tidewater.shared.dir", found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once a session, so that Python workers find them
    wherever they are started."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewater_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    if top.is_dir():
        to = os.path.join(tempfile.mkdtemp(prefix="tidewater-"), f"tidewater-{uuid.uuid4().hex[:8]}.zip")
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(to)
    sc._tidewater_shipped = True


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def save(df: DataFrame, name: str, **counts: Column) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, and a lost
    executor costs no more than the tasks it was running. The number of rows, and further counts by name, are taken on the way."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()]).write.option("compression", "zstd").parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved._tidewater_path, saved._tidewater_counts = path, seen.get
    return saved


def discard(*saved: DataFrame) -> None:
    """Deletes tables made by save that nothing reads any more."""
    for df in saved:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tidewater_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows in which hot keys are looked for, keys that count as hot at most (those with 1/HOT_KEYS of the rows or more), tables too small to
#: have any, and parts that the rows of a hot key are dealt to.
HOT_SAMPLE, HOT_KEYS, HOT_LEAST, HOT_PARTS = 200_000, 1_000, 5_000, 64


def identifier(column: Column) -> Column:
    """An identifier that sorts and joins like any value, nulls after all others."""
    return F.struct(column.isNull().alias("none"), F.coalesce(column.cast("long"), F.lit(0)).alias("value"))


def hot_keys(table: DataFrame, key: str, n_rows: int | None = None) -> list:
    """The keys that hold a good part of a table made by save, by a bounded sample of its rows. It decides only how rows travel."""
    n_rows = table._tidewater_counts["rows"] if n_rows is None else n_rows
    if n_rows < HOT_LEAST:
        return []
    least = min(n_rows, HOT_SAMPLE) // HOT_KEYS + 1
    sample = table.select(key).sample(min(1.0, HOT_SAMPLE / n_rows), seed=5)
    return [r[0] for r in sample.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()]


def spread_join(large: DataFrame, small: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """large joined with small, which has one row a key. The rows of hot keys, HOT_KEYS at most, are dealt to HOT_PARTS parts each, and
    the rows of small that they meet are repeated as often; all others travel as ever."""
    if not hot:
        return large.join(small, key, how)
    listed = F.broadcast(large.sparkSession.createDataFrame([(k, True) for k in hot], T.StructType([T.StructField(key, large.schema[key].dataType), T.StructField("_hot", T.BooleanType())])))
    every = F.array(*[F.lit(k) for k in range(HOT_PARTS)])
    dealt = large.withColumn("_row", F.monotonically_increasing_id()).join(listed, key, "left")
    dealt = dealt.withColumn("_part", F.when(F.col("_hot"), F.pmod(F.col("_row"), F.lit(HOT_PARTS)).cast("int")).otherwise(0)).drop("_row", "_hot")
    copies = small.join(listed, key, "left").withColumn("_part", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(copies, [key, "_part"], how).drop("_part")


def running_total(df: DataFrame, group: str, bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same group that come before, in the order
    of bucket, then ``order``. No task holds more than one bucket of a group: bucket sums are
    accumulated first (one small row each), then added to the running sums within the bucket."""
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = inner.join(sums, inner[group].eqNullSafe(sums["_g"]) & (inner[bucket] == sums["_b"]))
    return joined.withColumn(name, F.col("_before") + F.col("_within")).drop("_g", "_b", "_before", "_within")
