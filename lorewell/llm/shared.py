"""Small helpers of the operators: tables, written steps, task-local maps over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lorewell.operators.scratch import scratch_path, shuffle_partitions, written

__all__ = ["as_batches", "map_batches", "model", "one_model", "parts_for", "scratch_path", "shuffle_partitions",
           "slices",            "table", "text_of", "tokenizer_path", "written"]


MODELS: list[Callable] = []


def model(cached: Callable) -> Callable:
    """Enter a cached maker of a large object, of which a worker holds one kind at a time."""
    MODELS.append(cached)
    return cached


def one_model(kept: Callable | None = None) -> None:
    """A worker serves one stage after the other: drop what stages before have left in it."""
    for cached in MODELS:
        if cached is not kept:
            cached.cache_clear()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_of(column: str = "text"):
    """The text as a string, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def parts_for(df: DataFrame, rows: int, rows_per_part: int) -> int:
    """Partitions for so many rows: the session's number, or fewer for a small table."""
    return max(1, min(shuffle_partitions(df), math.ceil(rows / rows_per_part)))


def as_batches(
    schema: StructType, rows: Iterator[tuple], at_once: int = 10_000
) -> Iterator[pa.RecordBatch]:
    """Tuples in the order of the schema, as record batches."""
    arrow = to_arrow_schema(schema)
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= at_once:
            yield _batch(arrow, held)
            held = []
    if held:
        yield _batch(arrow, held)


def _batch(arrow: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[list[list]]:
    """Columns as lists, a few rows at a time, so that long texts are not all held twice."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield [c.to_pylist() for c in batch.slice(i, rows).columns]


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: str
) -> DataFrame:
    """mapInArrow for a function that yields tuples; one task sees one partition, in order."""
    kinds = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from as_batches(kinds, function(batches))

    return df.mapInArrow(run, kinds)
