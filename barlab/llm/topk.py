"""Exact top-k search by inner product: columnar branch-and-bound.

Rows are dealt by a hash of their id to blocks of candidates and to chunks of queries; each pair
of a block and a chunk is one group. In a group the candidates lie dimension by dimension. Scores
are accumulated one dimension block at a time for a whole chunk, then per query: what the dimensions that
remain can add or take away is at most the product of both remainders' norms, so a candidate
whose upper bound is below the k-th best lower bound is dropped and the survivors are compacted.
Each group yields its k best of each query, and these are merged.

Defined cases: a null id, and a vector that is null or holds null, NaN or infinity (also once scaled), takes no part;
rows that share an id count as one, with the smallest of their vectors; a shorter vector is
continued by zeros; ties go to the smaller id; with fewer than k candidates all are returned; an
empty table gives no rows. A score outside the range of long counts as its nearest long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.llm.common import quoted, vectors

BLOCK_ROWS = 4096       # candidates of a group
CHUNK_ROWS = 2048       # queries of a group
STEP = 16               # dimensions of a block
EXACT = float(1 << 53)


def dense(ids: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in ascending order and a row for each, padded with zeros."""
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False)
    flat = flat[lists.offsets[0].as_py():lists.offsets[-1].as_py()] if len(size) else flat[:0]
    width = int(size.max(initial=0))
    rows = np.zeros((len(size), width))
    rows[np.arange(width) < size[:, None]] = flat
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*rows.T[::-1], ids))
        ids, rows = ids[order], rows[order]
        first = np.r_[True, ids[1:] != ids[:-1]]
        return ids[first], rows[first]
    order = np.argsort(ids)
    return ids[order], rows[order]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int):
    """(query id, ids, scores) of each query's k best candidates of the block, by bounds."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    if width and len(c) and len(q) and width * np.abs(q).max() * np.abs(c).max() >= EXACT:
        yield from search_wide(q, q_ids, c, c_ids, k)
        return
    order = np.argsort(-(c * c).sum(0), kind="stable")              # heavy dimensions first
    q, columns = q[:, order], np.ascontiguousarray(c[:, order].T)
    cuts = list(range(0, width, STEP)) + [width]
    q_rest = [np.sqrt((q[:, at:] ** 2).sum(1)) for at in cuts]
    c_rest = [np.sqrt((columns[at:] ** 2).sum(0)) for at in cuts]
    for start in range(0, len(q), 128):
        part = q[start:start + 128]
        head = part[:, :cuts[1]] @ columns[:cuts[1]] if width else np.zeros((len(part), len(c)))
        for i in range(len(part)):
            at, alive = start + i, np.flatnonzero(c_ids != q_ids[start + i])
            score = head[i][alive]
            for b in range(1, len(cuts)):
                if len(alive) > k:
                    slack = q_rest[b][at] * c_rest[b][alive] * (1 + 1e-9) + 1e-6
                    floor = np.partition(score - slack, len(alive) - k)[len(alive) - k]
                    keep = score + slack >= floor
                    alive, score = alive[keep], score[keep]
                if b + 1 < len(cuts):
                    score = score + part[i, cuts[b]:cuts[b + 1]] @ columns[cuts[b]:cuts[b + 1], alive]
            top = best(score, c_ids[alive], k)
            yield q_ids[at], c_ids[alive][top], score[top].astype(np.int64)


def search_wide(q, q_ids, c, c_ids, k):
    """The same for products beyond the integers that a double holds, in whole numbers."""
    low, high = -(1 << 63), (1 << 63) - 1
    c = [[int(x) for x in row] for row in c]
    for one, row in zip(q_ids, q):
        row = [int(x) for x in row]
        score = lambda other: max(low, min(high, sum(a * b for a, b in zip(row, other))))
        found = sorted((-score(other), int(j)) for other, j in zip(c, c_ids) if j != one)[:k]
        yield one, np.array([j for _, j in found], np.int64), np.array([-s for s, _ in found], np.int64)


def grouped(k: int):
    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks()
        role, ids = batch["is_query"].to_numpy(), batch["vec_id"].to_numpy()
        lists = batch["v"].combine_chunks() if isinstance(batch["v"], pa.ChunkedArray) else batch["v"]
        q_ids, q = dense(ids[role], lists.filter(pa.array(role)))
        c_ids, c = dense(ids[~role], lists.filter(pa.array(~role)))
        found = list(search_block(q, q_ids, c, c_ids, k)) if len(q_ids) and len(c_ids) else []
        none = np.zeros(0, np.int64)
        return pa.table({
            "query_id": np.concatenate([none, *[np.full(len(ids), one, np.int64) for one, ids, _ in found]]),
            "vec_id": np.concatenate([none, *[ids for _, ids, _ in found]]),
            "score": np.concatenate([none, *[s for _, _, s in found]])})
    return run


def whole_number(x: Column) -> Column:
    """The floor as a double; a double of 2^53 or more is whole as it is."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def top_k(rows: DataFrame, every: int, k: int, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding",
          block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each row whose id ``every`` divides,
    by the inner product of floor(scale * x)."""
    whole = vectors(rows, vec_id, vector).select(
        "vec_id", F.transform("v", lambda x: whole_number(x * scale)).alias("v")).filter(
        ~F.exists("v", lambda x: F.abs(x) == float("inf")))
    is_query = F.col("vec_id") % every == 0
    size = rows.select(F.count("*").alias("n"), F.count_if(quoted(vec_id).cast("long") % every == 0).alias("q")).first()
    blocks, chunks = max(1, math.ceil(size["n"] / block_rows)), max(1, math.ceil(size["q"] / chunk_rows))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = whole.select(deal(blocks).alias("block"), numbers(chunks).alias("chunk"), F.lit(False).alias("is_query"), "vec_id", "v")
    queries = whole.filter(is_query).select(numbers(blocks).alias("block"), deal(chunks).alias("chunk"), F.lit(True).alias("is_query"), "vec_id", "v")
    found = candidates.union(queries).groupBy("block", "chunk").applyInArrow(
        grouped(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
WHERE r <= 5"""
