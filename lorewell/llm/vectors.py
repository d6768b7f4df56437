"""Vectors in blocks: what takes part, binary blocks of bounded size, pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.shared import map_batches, shuffle_partitions

BLOCK = 8_192
QUERY_BLOCK = 1_024
BLOCK_SCHEMA = "part int, width int, rows int, ids binary, data binary"


def usable(column: str, zero: bool) -> Column:
    """Has components, none null or not finite; `zero`: all-zero vectors are usable too."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.size(column) > 0
    return F.coalesce(some & finite & (F.lit(zero) | F.exists(column, lambda x: x != 0)), F.lit(False))


def usable_vectors(rows: DataFrame, key: str = "vec_id", column: str = "embedding", zero: bool = True) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part; rows without an id do not."""
    return rows.filter(usable(column, zero) & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("vec")
    )


def blocks(rows: DataFrame, dtype: str, size: int) -> DataFrame:
    """Blocks of at most `size` rows of (part, vec_id, vec) as BLOCK_SCHEMA.

    Consecutive rows of equal part and width share a block, so sort by part before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, ids, vectors = None, [], []

        def block() -> tuple:
            data = np.array(vectors, dtype)
            return *key, len(ids), np.array(ids, "<i8").tobytes(), data.tobytes()

        for batch in batches:
            for part, number, vector in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (len(ids) == size or key != (part, len(vector))):
                    yield block()
                    ids, vectors = [], []
                key = part, len(vector)
                ids.append(number)
                vectors.append(vector)
        if ids:
            yield block()

    return map_batches(rows.select("part", "vec_id", "vec"), run, BLOCK_SCHEMA)


def unpacked(ids: bytes, data: bytes, width: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, dtype).reshape(-1, width)


def block_pairs(rows: DataFrame, queries: DataFrame, pairs: int) -> DataFrame:
    """Every block of rows beside every block of queries of its part and width.

    `rows` and `queries` are blocks; `pairs` says how many pairs there are about. Columns of
    queries get a q_ in front; `q_block` numbers their blocks.
    """
    q = queries.select(
        "part", "width", F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"),
        F.col("data").alias("q_data"), "q_block",
    )
    spread = min(2 * pairs, 16 * shuffle_partitions(rows)) or 1
    met = rows.withColumn("v_block", F.xxhash64("ids")).join(q, ["part", "width"])
    return met.repartition(spread, "v_block", "q_block").sortWithinPartitions("v_block")


def numbered_queries(queries: DataFrame, dtype: str) -> DataFrame:
    """Blocks of queries with `q_block`; write them, as the number is that of the place."""
    return blocks(queries, dtype, QUERY_BLOCK).withColumn("q_block", F.monotonically_increasing_id())
