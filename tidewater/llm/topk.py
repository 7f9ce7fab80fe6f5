"""Exact top-k search by inner product, with a table of distances to pivots."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, save, ship

#: Rows from which pivots and first thresholds are taken, queries broadcast at once (8 kB each at most 512 components
#: and 64 pivots), pivots looked at between two eliminations, candidates evaluated between two looks at the bound.
SAMPLE, BLOCK, PIVOT_STEP, STEP = 2048, 8192, 16, 128
#: Below this, sums of products are exact in doubles; from WHOLE on, doubles are whole numbers.
EXACT, WHOLE = 2.0**53, 2.0**52
#: Stands for a null identifier while partitions are searched: above every long.
NO_ID = 2**63


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots: one row after the other that is farthest from those chosen."""
    chosen = [int(np.argmax((sample * sample).sum(1)))]
    near = distances(sample, sample[chosen])[:, 0]
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def scores_of(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact integer inner products, held to the range of a long."""
    if not len(x):
        return []
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if largest < EXACT:
        return (x @ q).astype(np.int64).tolist()
    own = [int(c) for c in q]
    return [min(max(sum(int(a) * b for a, b in zip(row, own, strict=True)), -(2**63)), 2**63 - 1) for row in x]


class Best:
    """The k best (score, -id) of one query; its worst is the threshold."""

    def __init__(self, k: int, floor: float):
        self.k, self.heap, self.floor = k, [], floor

    def add(self, scores: list[int], ids: list[int]) -> None:
        for pair in zip(scores, (-i for i in ids), strict=True):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, pair)
            elif pair > self.heap[0]:
                heapq.heapreplace(self.heap, pair)

    @property
    def threshold(self) -> float:
        return max(self.floor, self.heap[0][0]) if len(self.heap) == self.k else self.floor


def search(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    """Candidates (id, vec) against all queries of a block; gives this partition's best of each query."""
    queries, floors, pivots = shared.value
    best = [Best(k, floor) for floor in floors]
    table = distances(queries, pivots)
    norms = (queries * queries).sum(1)
    for batch in batches:
        ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], object)
        x = batch.column(1).flatten().to_numpy().reshape(len(ids), queries.shape[1])
        own = distances(x, pivots)  # the pivot table
        square = (x * x).sum(1)
        for q in range(len(queries)):
            alive, low, most = np.arange(len(ids)), np.zeros(len(ids)), np.zeros(0)
            for p in range(0, len(pivots), PIVOT_STEP):
                here = np.abs(own[alive, p : p + PIVOT_STEP] - table[q, p : p + PIVOT_STEP]).max(1)
                low = np.maximum(low, here)
                most = (square[alive] + norms[q] - low * low) / 2
                most += 1 + 1e-9 * (square[alive] + norms[q])  # what rounding may have taken
                stay = most >= best[q].threshold
                alive, low, most = alive[stay], low[stay], most[stay]
            order = np.argsort(-most)
            alive, most = alive[order], most[order]
            for i in range(0, len(alive), STEP):
                if most[i] < best[q].threshold:
                    break
                rows = alive[i : i + STEP]
                best[q].add(scores_of(x[rows], queries[q]), ids[rows].tolist())
    found = [(q, None if i == -NO_ID else -i, s) for q, b in enumerate(best) for s, i in b.heap]
    yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], names=["q", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024, n_pivots: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds, the k other rows with the largest integer
    inner product of the vectors floor(scale * x); ties go to the smaller identifier.

    A query's distances to the pivots and a candidate's bound their distance from below, hence their inner product from
    above, since 2 xy = |x|^2 + |y|^2 - |x - y|^2. Candidates whose bound falls short of the query's threshold
    go without being evaluated; the others are evaluated in the order of their bounds until the next bound falls short. The first
    thresholds come from the sample that the pivots come from, so they are scores that some rows do reach.

    Queries are taken in blocks of a fixed number, one after the other: a block is broadcast, held against all rows, which stay where
    they are read, its result is written to the shared folder, and its broadcast is dropped. A partition gives k + 1 rows a query at most.

    Vectors that are null or hold a null or a non-finite component (also after scaling) take no part; neither do queries with a null
    identifier. A candidate with a null identifier comes after all others of its score. Vectors of different lengths don't meet. Of repeated
    rows each is a query, and a candidate for the others. Scores beyond a long are held to its limits. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)

    def scaled(x: Column) -> Column:
        return x.cast("double") * scale

    sound = F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(scaled(x)) == float("inf")))
    vec = F.transform(vec_col, lambda x: F.when(F.abs(scaled(x)) < WHOLE, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), (is_query & F.col(id_col).isNotNull()).alias("asks"))
    queries = save(rows.where("asks").groupBy("id", "vec").agg(F.count(F.lit(1)).alias("times")).withColumn("dim", F.size("vec")), "topk-queries")
    results: list[DataFrame] = []
    for dim, n in sorted(queries.groupBy("dim").count().collect()):
        own = queries.where(F.col("dim") == dim)
        n_blocks = -(-n // BLOCK)
        same = rows.where(F.size("vec") == dim).select("id", "vec")
        chosen = same.orderBy(F.xxhash64("id", "vec"), "id").limit(SAMPLE).collect()
        sample = np.array([r.vec for r in chosen], float).reshape(len(chosen), dim)
        pivots = spread_out(sample, n_pivots)
        for b in range(n_blocks):
            block = own.where(F.pmod(F.xxhash64("id", "vec"), F.lit(n_blocks)) == b).orderBy("id", "vec").collect()
            if not block:
                continue
            matrix = np.array([r.vec for r in block], float).reshape(len(block), dim)
            floors = []
            for q in matrix:
                s = sorted(scores_of(sample, q), reverse=True)
                floors.append(float(s[k]) if len(s) > k else -float("inf"))
            shared = spark.sparkContext.broadcast((matrix, floors, pivots))
            found = same.mapInArrow(_searcher(shared, k + 1), "q long, vec_id long, score long")
            by_query = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
            found = found.withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= k + 1)
            names = spark.createDataFrame([(i, r.id, scores_of(matrix[i : i + 1], matrix[i])[0], r.times) for i, r in enumerate(block)], "q long, query_id long, self long, times long")
            # one row that is the query itself goes
            itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self"))
            at = F.min(F.when(itself, F.col("place"))).over(Window.partitionBy("q"))
            found = found.join(F.broadcast(names), "q").withColumn("_at", at).where(F.col("_at").isNull() | (F.col("place") != F.col("_at")))
            found = found.withColumn("rank", F.col("place") - F.when(F.col("_at") < F.col("place"), 1).otherwise(0)).where(F.col("rank") <= k)
            results.append(save(found.select("query_id", F.explode(F.sequence(F.lit(1), "times")).alias("_time"), F.col("rank").cast("int").alias("rank"), "vec_id", "score").drop("_time"), "topk-result"))
            shared.unpersist()
    discard(queries)
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema(results[0].schema).parquet(*[r._tidewater_path for r in results])


def _searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return search(batches, shared, k)

    return run


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
