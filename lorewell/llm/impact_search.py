"""Exact top-k by inner product: an impact-ordered index read score at a time.

Vectors are cut into blocks. A block's index holds, for each dimension, posting segments of rows of
equal quantised component. A query reads all segments of a block by descending impact (query
component times segment bound) and adds lower bounds to its accumulators. From time to time
it asks for proof: rows whose upper bound, with all that is still unread, stays below the
k-th best lower bound cannot be members. Once few enough rows are left they are rescored
exactly; without proof all segments are read. A block of rows is indexed where the blocks of
queries come to it, and gives k rows back for every query.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
without vec_id; vectors are compared with those of equal length only. Ties go to the
smaller vec_id; rows of the query's own vec_id are no candidates. A repeated query row is
answered again. Scores are 64-bit integers. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.llm.shared import map_batches, shuffle_partitions, table, written
from lorewell.llm.vectors import BLOCK, QUERY_BLOCK, blocks, numbered_queries, unpacked, usable_vectors

K = 5
LEVELS = 64
# Segments are read in so many steps; after each a proof is tried.
STEPS = 8
FEW = 256


class ImpactIndex:
    """Posting segments of one block of integer vectors."""

    def __init__(self, values: np.ndarray):
        self.values = values
        spread = int(values.max(initial=0)) - int(values.min(initial=0))
        shift = max(0, spread.bit_length() - LEVELS.bit_length() + 1)
        rows, dims, low, sizes = [], [], [], []
        for dim in range(values.shape[1]):
            level = values[:, dim] >> shift
            order = np.argsort(level, kind="stable")
            found, count = np.unique(level, return_counts=True)
            rows.append(order)
            low.append(found << shift)
            sizes.append(count)
            dims.append(np.full(len(found), dim))
        self.segments = [part for order, count in zip(rows, sizes) for part in np.split(order, np.cumsum(count)[:-1])]
        self.dims, self.low, self.sizes = map(np.concatenate, (dims, low, sizes))
        self.slack = (1 << shift) - 1

    def top(self, query: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Rows that hold the k best, proven; rows in `own` do not count."""
        n, width = self.values.shape
        if n - len(own) <= k:
            return np.setdiff1d(np.arange(n), own)
        weight = query[self.dims].astype(np.int64)
        a, b = weight * self.low, weight * (self.low + self.slack)
        least, most = np.minimum(a, b), np.maximum(a, b)
        order = np.argsort(-np.maximum(np.abs(a), np.abs(b)), kind="stable")
        gap = float(np.abs(query).sum()) * self.slack
        score = np.zeros(n)
        left = np.arange(n)
        step = -(-len(order) // STEPS)
        for first in range(0, len(order), step):
            read, unread = order[first : first + step], order[first + step :]
            postings = np.concatenate([self.segments[i] for i in read.tolist()])
            score += np.bincount(postings, np.repeat(least[read], self.sizes[read]), n)
            if first and 2 * first < len(order) - step:
                continue
            low, high = np.zeros(width), np.zeros(width)
            np.minimum.at(low, self.dims[unread], least[unread])
            np.maximum.at(high, self.dims[unread], most[unread])
            certain = score + low.sum()
            certain[own] = -np.inf
            kth = np.partition(certain, n - k)[n - k]
            left = np.flatnonzero(score + high.sum() + gap >= kth)
            if len(left) <= max(FEW, n // 16):
                break
        return np.setdiff1d(left, own, assume_unique=True)


def _search(k: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        here, kept = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if here != (row["part"], row["piece"]):
                    here, kept = (row["part"], row["piece"]), {}
                ids, values = unpacked(row["ids"], row["data"], row["width"], dtype)
                if row["q_block"] is None:
                    kept.setdefault(row["width"], []).append((ids, ImpactIndex(values)))
                    continue
                for of, index in kept.get(row["width"], ()):
                    for number, (name, query) in enumerate(zip(ids.tolist(), values)):
                        rows = index.top(query, k, np.flatnonzero(of == name))
                        exact = index.values[rows] @ query
                        best = np.lexsort((of[rows], -exact))[:k]
                        for j in best.tolist():
                            yield row["q_block"], number, name, int(of[rows[j]]), int(exact[j])

    return run


def met_blocks(index: DataFrame, asking: DataFrame, parts: int, asked: int) -> DataFrame:
    """Blocks of rows, each part's before the blocks of queries that it is asked.

    A block of queries goes to every part. Few parts are cut into pieces, which have all rows of
    their part and a share of the queries, so that all tasks have work. Blocks travel in a shuffle
    and never through the driver, however small their files are.
    """
    tasks = 4 * shuffle_partitions(index)
    pieces = max(1, min(asked, math.ceil(tasks / parts)))
    every = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece")
    share = F.pmod(F.shiftright("q_block", 33), F.lit(pieces)).cast("int").alias("piece")
    block = ["width", "ids", "data"]
    listed = index.select("part", every, F.lit(None).cast("bigint").alias("q_block"), *block)
    at = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    both = listed.unionByName(asking.select(at, share, "q_block", *block))
    spread = both.repartition(min(2 * parts * pieces, 4 * tasks), "part", "piece")
    return spread.sortWithinPartitions("part", "piece", F.col("q_block").isNotNull())


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; both tables have vec_id and vec of integers."""
    dtype = "<i8"
    n, n_queries = rows.count(), queries.count()
    parts = max(1, math.ceil(n / BLOCK))
    slot = F.spark_partition_id().alias("part")
    index = written(blocks(rows.repartition(parts).select(slot, "vec_id", "vec"), dtype, BLOCK), "index")
    asked = math.ceil(n_queries / QUERY_BLOCK)
    zero = queries.repartition(max(1, asked)).select(F.lit(0).alias("part"), "vec_id", "vec")
    asking = written(numbered_queries(zero, dtype), "queries")
    found = map_batches(
        met_blocks(index, asking, parts, asked), _search(k, dtype),
        "q_block bigint, q_row int, query_id bigint, vec_id bigint, score bigint",
    )
    best = W.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable_vectors(table(spark, sf_dir, "embeddings"))
    whole = F.transform("vec", lambda x: F.floor(x * 256).cast("bigint"))
    rows = written(vectors.select("vec_id", whole.alias("vec")), "vectors")
    return exact_top_k(rows, rows.filter(F.pmod("vec_id", F.lit(50)) == 0))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    CAST(list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
