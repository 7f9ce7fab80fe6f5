"""Exact deduplication by content sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, save

#: Code points of a text that a splitter holds; its digest stands for what follows them.
HEAD = 32
#: About how many bytes of text and how many rows a range holds, up to MOST_RANGES of them; beyond that, ranges grow and the
#: external sort spills. The sampled keys, KEYS_A_RANGE for each range, are all that reaches the driver.
RANGE_BYTES, RANGE_ROWS, MOST_RANGES, KEYS_A_RANGE = 32 << 20, 500_000, 20_000, 12


def splitters_of(sample: DataFrame, key: Column, n_ranges: int) -> tuple[Column, int]:
    """Splitters as one constant array of keys in ascending order, and how many there are: quantiles of the sample's keys."""
    if n_ranges < 2:
        return F.array(), 0
    sample = sample.select(key.alias("key"))
    found = [r[0] for r in sample.orderBy("key").select(F.to_json("key")).collect()]
    chosen = list(dict.fromkeys(found[i * len(found) // n_ranges] for i in range(1, n_ranges) if found))
    parsed = F.from_json(F.lit("[" + ",".join(chosen) + "]"), f"array<{sample.schema['key'].dataType.simpleString()}>")
    return F.sort_array(parsed), len(chosen)  # a key that JSON doesn't give back as it was may have moved


def range_of(key: Column, splitters: Column, n: int) -> Column:
    """How many splitters are not above the key, by binary search."""
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    if not n:
        return F.lit(0)
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(splitters, at + step - 1) <= key), at + step).otherwise(at),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", range_bytes: int = RANGE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are normalised (A-Z lower-cased, null taken as empty) and sorted by content: by their first code points, then by the digest
    of the whole text, then by identifier. Splitters sampled from these keys cut that order into ranges of about equally many rows,
    each row goes to its range, and in each range an external sort puts equal texts side by side. Every row is compared with its
    neighbour in full; a run of equals is folded to its size and its smallest (or largest) identifier. A text that many
    rows hold goes over several neighbouring ranges, since splitters fall between its identifiers: a range's first run and the last run of
    the range before it are compared in full too, and equal ones are chained. That takes two rows per range; nothing is grouped by a
    hash, and only one shuffle carries texts.

    Nulls: a null text equals an empty one; a null identifier is kept only where no row of its group
    has one. Ties: of repeated rows with one identifier and one text exactly one is kept; such rows share a range. An empty table
    gives no rows. Other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    best = F.min if keep == "min" else F.max
    first = F.asc_nulls_last if keep == "min" else F.desc_nulls_last
    n_rows, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    n_ranges = max(1, min(MOST_RANGES, max(-(-n_bytes // range_bytes), -(-n_rows // range_rows))))

    text = F.coalesce(F.col(text_col), F.lit(""))

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(id_col).alias("doc_id"), ascii_lower(text).alias("norm")).select(
            "doc_id", "norm", F.substring("norm", 1, HEAD).alias("head"), F.sha2("norm", 256).alias("text_sha256"), F.col("doc_id").isNull().alias("no_id")
        )

    order = ["head", "text_sha256", "no_id", "doc_id"]
    key = F.struct(*order)
    wanted = n_ranges * KEYS_A_RANGE
    splitters, n_splitters = splitters_of(keyed(docs if n_rows <= wanted else docs.sample(wanted / n_rows, seed=3)), key, n_ranges)
    dealt = keyed(docs).withColumn("range", range_of(key, splitters, n_splitters)).repartitionById(n_splitters + 1, "range")

    by_range = Window.partitionBy("range").orderBy(*order)
    before, after = F.lag("norm").over(by_range), F.lead("norm").over(by_range)
    compared = dealt.select(
        "range", *order,
        F.coalesce(before == F.col("norm"), F.lit(False)).alias("same"),
        before.isNull().alias("opens"), after.isNull().alias("closes"),
        F.when(before.isNull() | after.isNull(), F.col("norm")).alias("edge"),
    )
    run = F.sum(F.when(F.col("same"), 0).otherwise(1)).over(by_range.rowsBetween(Window.unboundedPreceding, 0))
    numbered = compared.select("range", run.alias("run"), "doc_id", "text_sha256", "opens", "closes", "edge")
    in_run = Window.partitionBy("range", "run")
    runs = save(
        numbered.select(
            "*", F.row_number().over(in_run.orderBy(first("doc_id"))).alias("place"), best("doc_id").over(in_run).alias("run_id"), F.count(F.lit(1)).over(in_run).alias("run_size")
        ),
        "exact-runs",
    )

    # runs that go on in the next range
    edges = runs.where("opens or closes")
    outer = edges.select("range", "run", "run_id", "run_size").dropDuplicates(["range", "run"])
    along = Window.orderBy("range", "run")
    outer = outer.withColumn("from", F.lag("range").over(along))
    opening = edges.where("opens").select(F.col("range").alias("o_range"), F.col("edge").alias("o_text"))
    closing = edges.where("closes").select(F.col("range").alias("c_range"), F.col("edge").alias("c_text"))
    crossing = outer.where(F.col("from") < F.col("range")).select("range", "from")
    goes_on = crossing.join(opening, F.col("range") == F.col("o_range")).join(closing, F.col("from") == F.col("c_range")).where("o_text = c_text")
    goes_on = goes_on.select("range", F.lit(1).alias("run"), F.lit(True).alias("goes_on"))
    chained = outer.join(goes_on, ["range", "run"], "left").withColumn("chain", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("chain")
    chains = chained.select(
        "range", "run", F.count(F.lit(1)).over(chain).alias("links"), F.sum("run_size").over(chain).alias("size"), best("run_id").over(chain).alias("id"),
        (F.row_number().over(chain.orderBy(first("run_id"), "range", "run")) == 1).alias("holds"),
    ).where("links > 1").select("range", "run", "size", "id", "holds")
    # at most two rows per range
    return runs.join(F.broadcast(chains), ["range", "run"], "left").select(
        "doc_id", F.when(F.col("size").isNull(), F.col("run_id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("size", "run_size").alias("group_size"),
        ((F.col("place") == 1) & F.coalesce("holds", F.lit(True))).alias("kept"), "text_sha256",
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


OP1_SQL = r"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
"""
