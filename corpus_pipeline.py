"""A training corpus from raw documents, in five stages of the operators in tidewater.llm.

Each stage takes (spark, docs, sf_dir), works on all that the one before has kept, and returns a DataFrame, which is
written as Parquet and read back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.bpe import encode_and_decode
from tidewater.llm.common import WORD, ascii_lower, fresh, save
from tidewater.llm.exact_dedup import exact_dedup
from tidewater.llm.mixing import mixed_documents
from tidewater.llm.near_dedup import near_duplicates
from tidewater.llm.quality import THRESHOLD, fit_quality, score_quality


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the rows of ``labels`` that are in docs. Null and empty texts are
    scored like others, repeated rows alike; rows pass through as they are."""
    trees = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "_score")
    return score_quality(docs, trees, score).where(F.col(score) >= THRESHOLD).drop(score)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (but for the case of A-Z; a null one counts as empty) the one with the smallest identifier, and one row of it;
    a null identifier is larger than all others."""
    digest = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    return kept_rows(docs, digest, exact_dedup(docs).where("kept").select("doc_id", "text_sha256"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that is linked by a similarity of 0.8 or more of shingles of five words: one with the smallest
    identifier. Documents without words are linked with nothing and all stay."""
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    chosen = near_duplicates(docs, with_rows=True).where("chosen and n_shingles > 0").select("doc_id", "text_key")
    return kept_rows(docs.where(worded), F.xxhash64("text"), chosen).unionByName(docs.where(~worded))


def kept_rows(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """One row of docs for each (identifier, key) in kept, null identifiers included. Which of several rows that agree in both
    is open. Rows meet in partial aggregates first, so a row that is often repeated is not a hot key; the identifier and the key
    are one struct, in which nulls are equal, so that the join needs no further shuffle of docs."""
    row = fresh(docs, "_row")
    single = docs.withColumn(row, F.struct(F.col("doc_id").alias("id"), key.alias("key"))).dropDuplicates([row])
    named = kept.distinct().select(F.struct(*(F.col(c).alias(n) for c, n in zip(kept.columns, ("id", "key"), strict=True))).alias(row))
    return single.join(named, row, "left_semi").select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, sources near their target weights, in the order of its schedule. Documents without words go;
    repeated rows each follow the mix."""
    return mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every row of the mix: doc_id, n_tokens, ids, and the text that they decode to. A null text has no tokens."""
    return encode_and_decode(docs)


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", distinct_documents),
    ("near_dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("bpe", encoded),
]

#: SQL states neither the classifier nor the encoder; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
