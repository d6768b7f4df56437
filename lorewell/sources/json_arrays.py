"""JSON files that hold one array each, read by many tasks.

Such a file is cut at closing braces, which Spark's text reader can do anywhere in it. Two
things must be known to make sense of a split: whether it begins inside a string, and how
deep it is in brackets. A first scan says of every split how many quotes it has and by how much
it changes the depth, for both cases; one row per split is then summed up along each file. In a
second scan every task cuts the elements out of its splits; only those that cross the border of a
split are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.operators.scratch import scratch_path, written
from lorewell.operators.sizes import broadcast_if_small

SPLIT = ("file", "start")
SUMMARY = {
    "file": pa.string(), "start": pa.int64(), "quotes": pa.int64(), "outside": pa.int64(), "inside": pa.int64(),
}
PARTS = {
    "file": pa.string(), "start": pa.int64(), "place": pa.int64(), "begins": pa.bool_(), "ends": pa.bool_(),
    "value": pa.string(),
}
ESCAPED = re.compile(rb"\\.", re.DOTALL)
QUOTE, OPENING, CLOSING = ord('"'), (ord("{"), ord("[")), (ord("}"), ord("]"))


def _bytes(pieces: list[str]) -> tuple[bytes, np.ndarray]:
    """Text of consecutive pieces, and the same as numbers with escaped characters blanked out."""
    text = ("}".join(pieces) + "}").encode("utf-8", "surrogatepass")
    # a brace is never escaped, so no escape crosses a piece's end
    return text, np.frombuffer(ESCAPED.sub(b"..", text), np.uint8)


def _depth_steps(codes: np.ndarray, in_string: int) -> tuple[np.ndarray, int]:
    """+1 and -1 at brackets outside strings, and how many quotes there are."""
    quotes = codes == QUOTE
    before = np.cumsum(quotes) - quotes
    free = (before + in_string) & 1 == 0
    steps = np.isin(codes, OPENING).astype(np.int64) - np.isin(codes, CLOSING)
    return steps * free, int(quotes.sum())


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], list]]:
    """Runs of pieces of one split, with the other columns of the run's first row."""
    for batch in batches:
        values, files, starts, *others = (c.to_pylist() for c in batch.columns)
        first = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or (files[i], starts[i]) != (files[first], starts[first]):
                yield (files[first], starts[first]), values[first:i], [c[first] for c in others]
                first = i


def _batch(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in kinds]
    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds.values())]
    return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    names = {pa.string(): "string", pa.int64(): "bigint", pa.bool_(): "boolean"}
    return ", ".join(f"{c} {names[kind]}" for c, kind in kinds.items())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: quotes, and the change of depth if it begins outside or inside a string."""
    now, quotes, outside, inside = None, 0, 0, 0
    for split, pieces, _ in _by_split(batches):
        if split != now:
            if now:
                yield _batch(SUMMARY, [(*now, quotes, outside, inside)])
            now, quotes, outside, inside = split, 0, 0, 0
        _, codes = _bytes(pieces)
        ways = [int(_depth_steps(codes, (quotes + s) & 1)[0].sum()) for s in (0, 1)]
        quotes, outside, inside = quotes + int((codes == QUOTE).sum()), outside + ways[0], inside + ways[1]
    if now:
        yield _batch(SUMMARY, [(*now, quotes, outside, inside)])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of the arrays, whole or what a split has of them, numbered by where they begin."""
    now, in_string, depth, place, begun, held = None, 0, 0, 0, False, []

    def row(ends: bool) -> tuple:
        return *now, place, begun, ends, b"".join(held).decode("utf-8", "surrogatepass")

    def rest() -> list[tuple]:
        """What is open at the end of a split."""
        return [row(False)] if now and depth > 1 else []

    for split, pieces, (quotes, level) in _by_split(batches):
        rows = []
        if split != now:
            rows += rest()
            now, in_string, depth, place, held, begun = split, quotes & 1, level, 0, [], False
        text, codes = _bytes(pieces)
        steps, found = _depth_steps(codes, in_string)
        after = depth + np.cumsum(steps)
        borders = np.flatnonzero(((steps > 0) & (after == 2)) | ((steps < 0) & (after == 1)))
        at = 0
        for border in borders.tolist():
            if steps[border] > 0:
                at, begun, held, place = border, True, [], place + 1
            else:
                held.append(text[at : border + 1])
                rows.append(row(True))
                held, begun = [], False
        in_string, depth = (in_string + found) & 1, int(after[-1])
        if depth > 1:
            held.append(text[at:])
        yield _batch(PARTS, rows)
    yield _batch(PARTS, rest())


def split_arrays(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, start, place, value): the text of each element; places count from 1 in a split."""
    pieces = spark.read.option("lineSep", "}").text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    summed = pieces.mapInArrow(_summaries, _ddl(SUMMARY))
    along = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    quotes = F.coalesce(F.sum("quotes").over(along), F.lit(0))
    step = F.when(F.col("before") % 2 == 1, F.col("inside")).otherwise(F.col("outside"))
    entries = written(
        written(summed, "summaries").withColumn("before", quotes)
        .select(*SPLIT, "before", F.coalesce(F.sum(step).over(along), F.lit(0)).alias("level")),
        "entries",
    )
    known = broadcast_if_small(entries)
    joined = pieces.withColumn("_id", F.monotonically_increasing_id()).join(known, list(SPLIT))
    # entries that are too many to broadcast make the join shuffle: back into order then
    if known is entries:
        joined = joined.repartition(*SPLIT).sortWithinPartitions(*SPLIT, "_id")
    parts = written(
        joined.select("value", *SPLIT, "before", "level").mapInArrow(_elements, _ddl(PARTS)), "elements"
    )
    whole = parts.filter("begins and ends").select(*SPLIT, "place", "value")
    # at most two parts of a split are left, and those of an element follow each other
    crossing = parts.filter("not (begins and ends)")
    number = F.sum(F.col("begins").cast("bigint")).over(
        W.partitionBy("file").orderBy("start", "place").rowsBetween(W.unboundedPreceding, 0)
    )
    listed = F.array_sort(F.collect_list(F.struct("start", "place", "value")))
    joint = crossing.withColumn("_n", number).groupBy("file", "_n").agg(listed.alias("ps"))
    stitched = joint.select(
        "file", F.col("ps")[0]["start"].alias("start"), F.col("ps")[0]["place"].alias("place"),
        F.array_join(F.transform("ps", lambda p: p["value"]), "").alias("value"),
    )
    return whole.unionByName(stitched)


def read_array_files(
    spark: SparkSession, paths: str | list[str], schema: str | None = None
) -> DataFrame:
    """(file, episode_id, fields): one row per element, counted from 1 in each file.

    Without `schema` the fields are found in one more scan of the elements.
    """
    found = written(split_arrays(spark, paths), "array-elements")
    if schema is None:
        lines = scratch_path(spark, "array-lines")
        # a line break inside an element stands between its tokens
        found.select(F.translate("value", "\r\n", "  ").alias("value")).write.text(lines)
        schema = spark.read.json(lines).schema
    sizes = found.groupBy(*SPLIT).agg(F.count("*").alias("_n"))
    along = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*SPLIT, F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    numbered = found.join(broadcast_if_small(written(before, "offsets")), list(SPLIT))
    return numbered.select(
        "file", (F.col("_before") + F.col("place")).alias("episode_id"), F.from_json("value", schema).alias("_e")
    ).select("file", "episode_id", "_e.*")
