"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, running_total, save, word_count

#: Largest number of sources whose table is broadcast; a row of it takes well under 200 bytes.
BROADCAST_SOURCES = 10_000
#: One step of the bit reversal of a 32-bit number: mask and shift.
REVERSAL = ((0x55555555, 1), (0x33333333, 2), (0x0F0F0F0F, 4), (0x00FF00FF, 8), (0x0000FFFF, 16))


def radical_inverse(i: Column) -> Column:
    """The van der Corput point of i < 2**32 in base 2: its 32 bits in reverse, as a fraction."""
    x = i.cast("long")
    for mask, shift in REVERSAL:
        x = F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), shift))
    return x / F.lit(float(2**32))


def source_targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """One row per source: ``source, source_size, weight, target`` and the interval ``lo, hi`` of [0, 1) that its
    share of all words takes. Sources in order of code points, nulls last, weigh 1, 2, 3, repeating. Targets are
    the water level at which all words are shared by weight and none is above ``cap`` times its source.

    All windows here are over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("_cap", cap * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("_cap") / F.col("weight"), F.asc_nulls_last("source"))
    fuller = filling.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_all", F.sum("source_size").over(everything).cast("double"))
    # the level if every source that fills up sooner is full
    rest = F.col("_all") - F.coalesce(F.sum("_cap").over(fuller), F.lit(0.0))
    heft = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fuller), F.lit(0.0))
    per = per.withColumn("_level", rest / heft).withColumn("_open", F.col("_cap") / F.col("weight") >= F.col("_level"))
    # the levels rise up to the first source that stays open, and fall from there on
    level = F.max(F.when(F.col("_open"), F.col("_level"))).over(everything)
    per = per.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("weight"), F.col("_cap"))))
    below = by_name.rowsBetween(Window.unboundedPreceding, -1)
    total = F.greatest(F.sum("target").over(everything), F.lit(1.0))
    per = per.withColumn("lo", F.coalesce(F.sum("target").over(below), F.lit(0.0)) / total)
    return per.withColumn("hi", F.coalesce(F.lead("lo").over(by_name), F.lit(1.0))).select("source", "source_size", "weight", "target", "lo", "hi")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, block: int = 4096, cap: int = 3) -> DataFrame:
    """One row per document: ``doc_id, text_key, source, size, source_size, target, taken`` (words; repeats counted), ``slots``.

    Each source's documents are shuffled by a hash, laid end to end and cut into blocks of ``block``
    words. Slot i of the schedule takes the van der Corput point of i,
    which falls into one source's share of the unit interval; slots are ranked within their source, and the
    slot of rank r takes the source's r-th block, from the first again after the last. The last slot of a source
    takes just what its target leaves. Where a source's points fall short of its slots, some are added at the schedule's end: log2 of the number of
    slots plus cap + 2 at most, since the points' share of an interval is off by no more and each cycle's last block may be a short one.
    So a source's taken words equal its target, rounded, and no document exceeds ``cap`` times its size.
    ``slots`` are the places in the schedule of the block that a document begins in, one for each time it is taken: in their order the sources are mixed.

    A hot source is dealt out by hash buckets: no task sorts or counts a source as a whole. Texts are read
    once; everything after that is a few numbers a document.

    Nulls: a null text has size 0, a null source is the last source, a null identifier is passed through.
    Documents without words take part with 0. Repeated rows are documents of their own. An empty table gives no rows. Other columns are ignored.
    Documents of one identifier are told apart by ``text_key``, the 64-bit hash of their texts.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(source_col).alias("source"), F.coalesce(word_count(F.col(text_col)), F.lit(0)).alias("size"))
    sizes = save(read.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text_key")), "mix-sizes")
    targets = save(source_targets(sizes, cap), "mix-targets")
    n_sources, n_words = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda x: x)
    if n_words // block >= 2**32:
        raise ValueError(f"{n_words} words take blocks of more than {n_words >> 32} words: the schedule has 2**32 slots")

    whole = F.floor(F.col("target") + 0.5).cast("long")
    plan = (
        targets.withColumn("_want", whole)
        .where("_want > 0 and source_size > 0")
        .withColumn("_blocks", F.ceil(F.col("source_size") / block))
        .withColumn("_cycles", F.floor(F.col("_want") / F.col("source_size")))
        .withColumn("_rest", F.col("_want") - F.col("_cycles") * F.col("source_size"))
        .withColumn("_slots", F.col("_cycles") * F.col("_blocks") + F.ceil(F.col("_rest") / block))
        .select(F.col("source").alias("p_source"), "lo", "hi", "_blocks", "_cycles", "_rest", "_slots")
    )

    # the schedule
    n_slots = max(1, n_words // block)
    grid = 2 ** max(8, math.ceil(math.log2(4 * max(1, n_sources))))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), radical_inverse(F.col("id")).alias("point")).withColumn("cell", F.floor(F.col("point") * grid))
    cells = plan.where("hi > lo").select("p_source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * grid), F.floor(F.col("hi") * grid))).alias("cell"))
    chosen = slots.join(cells, "cell").where("point >= lo and point < hi").select(F.col("p_source").alias("source"), "slot", F.floor(F.col("slot") / max(1, n_slots // 1024)).alias("part"))
    ranked = running_total(chosen, "source", "part", ["slot"], F.lit(1), "rank").select("source", "rank", "slot")
    filled = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("_filled")).withColumnRenamed("source", "f_source")
    short = plan.join(filled, F.col("p_source").eqNullSafe(F.col("f_source")), "left").withColumn("_filled", F.coalesce("_filled", F.lit(0)))
    closing = short.where("_filled < _slots").select(F.col("p_source").alias("source"), F.explode(F.sequence(F.col("_filled"), F.col("_slots") - 1)).alias("rank")).withColumn("slot", F.lit(n_slots) + F.col("rank"))
    planned = small(plan)
    used = ranked.unionByName(closing).join(planned, F.col("source").eqNullSafe(F.col("p_source"))).where("rank < _slots")
    in_cycle = F.col("rank") < F.col("_cycles") * F.col("_blocks")
    last = (~in_cycle) & (F.col("rank") == F.col("_slots") - 1)
    taken_blocks = (
        used.select(
            "source", "slot",
            F.when(in_cycle, F.col("rank") % F.col("_blocks")).otherwise(F.col("rank") - F.col("_cycles") * F.col("_blocks")).alias("block"),
            F.when(last, 0).otherwise(1).alias("_full"),
            F.when(last, F.col("_rest") - (F.col("rank") - F.col("_cycles") * F.col("_blocks")) * block).otherwise(F.lit(0)).alias("_part"),
        )
        .groupBy("source", "block")
        .agg(F.sum("_full").alias("_full"), F.max("_part").alias("_part"), F.sort_array(F.collect_list("slot")).alias("_slots"))
        .withColumnRenamed("source", "b_source")
        .withColumnRenamed("block", "b_block")
    )

    # the documents' places in their source
    n_docs = sizes.count()
    bits = max(10, math.ceil(math.log2(max(1, n_docs / 2048))))
    placed = running_total(sizes.where("size > 0").withColumn("bucket", F.shiftrightunsigned("key", 64 - bits)), "source", "bucket", ["key", "doc_id", "text_key"], F.col("size"), "start")
    pieces = placed.select(
        "source", "doc_id", "text_key", "size", "start",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"),
    )
    joined = pieces.join(taken_blocks, pieces["source"].eqNullSafe(F.col("b_source")) & (pieces["block"] == F.col("b_block")), "left")
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    words = F.coalesce(F.col("_full"), F.lit(0)) * (high - low) + F.greatest(F.lit(0), F.least(high, F.col("block") * block + F.coalesce(F.col("_part"), F.lit(0))) - low)
    taken = joined.groupBy("source", "start", "doc_id", "text_key", "size").agg(F.sum(words).alias("taken"), F.min_by(F.coalesce("_slots", F.array().cast("array<long>")), "block").alias("slots"))
    wordless = sizes.where("size = 0").select("doc_id", "text_key", "source", "size", F.lit(0).cast("long").alias("taken"), F.array().cast("array<long>").alias("slots"))
    everyone = taken.select(wordless.columns).unionByName(wordless)
    about = small(targets.select(F.col("source").alias("t_source"), "source_size", "target"))
    return everyone.join(about, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "doc_id", "text_key", "source", "size", "source_size", F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken"), "slots"
    )


def mixed_documents(docs: DataFrame, block: int = 4096) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in the order of the schedule: taken / size times, rounded, for documents with words;
    those without words cost nothing and go. Repeated rows each follow the mix on their own. The columns are those of ``docs``.

    The mix has one row per document. The join is on identifier, text hash and source, so that nulls in one of them make no hot key.
    """
    key, times, slots, time, slot = (fresh(docs, name) for name in ("_key", "_times", "_slots", "_time", "_slot"))
    mixed = mix_sources(docs, block=block).where("taken > 0").groupBy("doc_id", "text_key", "source", "size").agg(F.max(F.struct("taken", "slots")).alias("most"))
    mixed = mixed.select(
        F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), F.col("source").alias("m_source"),
        F.floor(F.col("most.taken") / F.col("size") + 0.5).cast("int").alias(times), F.col("most.slots").alias(slots),
    ).where(F.col(times) > 0)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    on = keyed["doc_id"].eqNullSafe(mixed["m_id"]) & (keyed[key] == mixed["m_key"]) & keyed["source"].eqNullSafe(mixed["m_source"])
    copies = keyed.join(mixed, on).withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times))))
    # a document longer than a block may be taken once more than its first block is
    placed = copies.withColumn(slot, F.coalesce(F.get(slots, F.least(F.col(time), F.size(slots)) - 1), F.lit(0)))
    return placed.orderBy(slot).select(*[keyed[c] for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3_mixing that SQL states: sizes and targets, these rounded to words."""
    return op3_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.floor(F.col("target") + 0.5).cast("long").alias("target_words"))


MIXING_TARGETS_SQL = r"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::DOUBLE AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sizes GROUP BY source),
levels AS (SELECT a.source, (any_value(t.n) - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0)) / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS level, any_value(a.cap / a.weight) AS full_at
           FROM sources a, sources b, (SELECT sum(source_size)::DOUBLE AS n FROM sources) t GROUP BY a.source, a.cap, a.weight),
top AS (SELECT max(level) AS level FROM levels WHERE full_at >= level)
SELECT d.doc_id, d.size, s.source_size, floor(least(s.cap, coalesce(top.level * s.weight, s.cap)) + 0.5)::BIGINT AS target_words
FROM sizes d JOIN sources s ON s.source IS NOT DISTINCT FROM d.source, top
"""
