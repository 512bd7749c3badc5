"""Exact top-k search: norm-sorted inner products with Cauchy-Schwarz pruning.

Vectors are integers: floor(256 * x) of each component. Each task takes its vectors by descending
length. A rotation from the singular vectors of all vectors gathers most of the length in the first
dimensions, so a query needs the partial sums over those alone to bound the rest by the product of
the residual lengths. Vectors whose bound is below the query's current k-th score are pruned; as
lengths descend, all that follow a block whose plain length bound fails are pruned at once. The
scores of survivors are exact integer products, so floating point only ever prunes with slack.

Queries are dealt into blocks and vectors into groups of bounded size, and each block meets each group
in a task of its own, by a key; first thresholds come from the longest vectors of all. Every task
sends at most k rows a query.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows without a ``vec_id``; vectors of differing lengths are padded with zeros, an empty one is all
zeros; equal scores rank by smaller ``vec_id``; ``vec_id`` names a row, so rows that repeat one are
one query and never its candidates, while each is a candidate of other queries; an empty table
gives an empty result; other columns are ignored. Products whose sums may pass 2 ** 53 are taken in
whole numbers of any size; a score beyond 64 bits is given as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, EVERY = 5, 50
#: Queries in a block, vectors in a group, those that give first thresholds, and the rows of one product.
QUERY_BLOCK, GROUP, SEEDS, ROWS = 4096, 1 << 17, 1024, 1024
#: Vectors from which on there are groups for every core.
FEW = 2048
_LONG = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the vector times 256, of the rows that take part."""
    x = F.col("embedding")
    finite = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    scaled = F.transform(x, lambda e: F.lit(256.0) * e.cast("double"))
    return vectors.filter(finite & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors, rounded down, as rows of one matrix, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = np.floor(np.asarray(column.flatten()))
    return np.nan_to_num(out, posinf=np.finfo(float).max, neginf=np.finfo(float).min)


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every sum is a whole number below 2 ** 53."""
    if rows.size and np.abs(rows).max() * np.abs(query).max() * len(query) >= 2.0**53:
        whole = lambda m: np.array([int(x) for x in m.ravel()], object).reshape(m.shape)
        return whole(rows) @ whole(query)
    return (rows @ query).astype(np.int64)


def second_moments(vectors: DataFrame, width: int) -> np.ndarray:
    """The sum of v v' over all vectors, summed in each task and then by Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(1), width)
            total += m.T @ m
        total = np.nan_to_num(total)  # only turns what is pruned by
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "part"])

    cells = vectors.mapInArrow(run, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part")).collect()
    out = np.zeros(width * width)
    for row in cells:
        out[row["cell"]] = row["part"]
    return out.reshape(width, width)


def _rotation(moments: np.ndarray) -> np.ndarray:
    """The singular vectors of all vectors, those of most length first."""
    scale = np.abs(moments).max()
    return np.linalg.eigh(moments / scale if scale else moments)[1][:, ::-1]


def best(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, rotation: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, the k best (ids, scores) among the vectors that score ``floor`` or more."""
    with np.errstate(over="ignore", invalid="ignore"):
        head = max(1, len(rotation) // 4)
        length = np.sqrt((vectors**2).sum(axis=1))
        order = np.lexsort((ids, -length))
        ids, vectors, length = ids[order], vectors[order], length[order]
        turned_q = queries @ rotation
        rest_q = np.sqrt((turned_q[:, head:] ** 2).sum(axis=1))
        length_q = np.sqrt((queries**2).sum(axis=1))
        threshold = floor.astype(float).copy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
        alive = np.arange(len(query_ids))
        for a in range(0, len(ids), ROWS):
            slack = 1e-6 * (1 + length[a] * length_q)
            alive = alive[~(length_q[alive] * length[a] + slack[alive] < threshold[alive])]
            if not len(alive):
                break
            turned = vectors[a : a + ROWS] @ rotation
            rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
            bound = turned_q[alive, :head] @ turned[:, :head].T + np.outer(rest_q[alive], rest)
            keep = ~(bound + slack[alive, None] < threshold[alive, None])  # what can't be told stays
            for row in np.flatnonzero(keep.any(axis=1)):
                q = alive[row]
                at = a + np.flatnonzero(keep[row])
                at = at[ids[at] != query_ids[q]]
                all_ids, all_scores = np.concatenate([found[q][0], ids[at]]), np.concatenate([found[q][1], _products(vectors[at], queries[q])])
                top = np.lexsort((all_ids, -all_scores))[:k] if all_scores.dtype != object else np.array(sorted(range(len(all_ids)), key=lambda i: (-all_scores[i], all_ids[i]))[:k], int)
                found[q] = all_ids[top], all_scores[top]
                if len(top) == k:
                    threshold[q] = max(threshold[q], float(found[q][1][-1]))
    return found


def _clipped(scores: list[np.ndarray]) -> pa.Array:
    return pa.array([max(-_LONG - 1, min(_LONG, int(x))) for s in scores for x in s], pa.int64())


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best other rows of ``vectors``."""
    spark = vectors.sparkSession
    v = common.written(usable(vectors), "vectors")
    first = v.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    width, n = first["width"] or 1, first["n"]
    rotation = _rotation(second_moments(v, width))
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)
    longest = v.orderBy(norm.desc(), "vec_id").limit(SEEDS).toArrow()
    seeds = spark.sparkContext.broadcast((np.asarray(longest["vec_id"]), _matrix(longest["v"], width), rotation))
    schema = "vec_id long, v array<double>, floor double"

    def thresholds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, rotation = seeds.value
        for batch in batches:
            mine, asked = np.asarray(batch.column(0)), _matrix(batch.column(1), width)
            got = best(ids, rows, mine, asked, np.full(len(mine), -np.inf), rotation, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([float(s[-1]) if len(s) == k else -np.inf for _, s in got])], ["vec_id", "v", "floor"])

    queries = common.written(v.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(thresholds, schema), "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    groups = max(1, -(-n // GROUP), min(spark.sparkContext.defaultParallelism, n // FEW))
    to = lambda name, many: F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(name)
    dealt = v.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group"), to("block", blocks))
    asked = queries.select("vec_id", "v", "floor", to("group", groups), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        query_ids, rotation = np.asarray(asked["vec_id"]), seeds.value[2]
        found = best(np.asarray(rows["vec_id"]), _matrix(rows["v"], width), query_ids, _matrix(asked["v"], width), np.asarray(asked["floor"]), rotation, k) if len(rows) and len(asked) else []
        none = [np.zeros(0, np.int64)]
        return pa.table([pa.array(np.repeat(query_ids[: len(found)], [len(x) for x, _ in found]).astype(np.int64)), pa.array(np.concatenate([x for x, _ in found] or none)), _clipped([s for _, s in found])], ["query_id", "vec_id", "score"])

    some = dealt.groupBy("group", "block").cogroup(asked.groupBy("group", "block")).applyInArrow(search, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return some.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector, against all others."""
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % {EVERY} = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
) WHERE rank <= {K}
"""
