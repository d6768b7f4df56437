"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous best-fit. A round sorts documents and gaps by size, descending, over all
partitions. Every document then takes the smallest gap still free that holds it: read in
that order gaps open and documents close, so the match is that of brackets. Each partition
matches its own brackets; what is left over is matched across partitions by rank, from the
counts per partition alone. Gaps are updated and the next round begins. New sequences are
opened where hardly a document finds a gap.

Null text is empty; a null doc_id stays null. Repeated rows are packed once each. Among
equal sizes the order is that of the numbers given to the pieces. An empty table gives no
rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.pretokens import chunks, encoder
from lorewell.llm.shared import (
    map_batches, one_model, parts_for, slices, table, text_of, tokenizer_path, written,
)

CAPACITY = 2048
END = 0
ROWS_PER_PART = 50_000
# Below this share of documents placed in a round, new sequences are opened.
FEW = 0.25


def document_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of every text's ids and the end id: doc_id, piece, start, length, ids_crc32, item.

    Only documents over the capacity are cut; their first piece may be shorter. `item`
    numbers the pieces; the table is written, so the numbers hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        one_model(encoder)
        coder = encoder(path)
        for names, texts in slices(batches):
            done = 0
            for group in chunks(texts):
                for name, ids in zip(names[done : done + len(group)], coder.encode(group)):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    head = len(ids) % capacity or capacity
                    cuts = [0, *range(head, len(ids) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        yield name, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())
                done += len(group)

    pieces = map_batches(
        docs.select(F.col("doc_id").cast("bigint"), text_of()),
        run,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint",
    )
    return written(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")


def _local_sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Match inside one partition, sizes descending: (what, item, sequence, size, rank)."""
    free: list[tuple[int, int]] = []
    lone = 0
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(3))
        for size, is_document, number in zip(*columns):
            if not is_document:
                free.append((number, size))
            elif free:
                sequence, room = free.pop()
                yield "placed", number, sequence, room, 0
                room -= size
                if room >= size:  # still the smallest free gap, and not behind the sweep
                    free.append((sequence, room))
                elif room:
                    yield "later", None, sequence, room, 0
            else:
                yield "document", number, None, size, lone
                lone += 1
    for rank, (sequence, room) in enumerate(reversed(free)):
        yield "gap", None, sequence, room, rank


def _across(counts: dict[int, tuple[int, int]]) -> dict[str, list[tuple[int, int, int, int]]]:
    """Ranges of left-over documents and gaps that match each other across partitions.

    `counts`: documents and gaps left over in each partition. The result lists for either
    side (partition, first rank, number of rows, number of the first match).
    """
    open_gaps: list[list[int]] = []  # partition, next rank, rows
    ranges: dict[str, list[tuple[int, int, int, int]]] = {"document": [], "gap": []}
    matches = 0
    for part in sorted(counts):
        documents, gaps = counts[part]
        rank = 0
        while documents and open_gaps:
            top = open_gaps[-1]
            rows = min(documents, top[2])
            ranges["document"].append((part, rank, rows, matches))
            ranges["gap"].append((top[0], top[1], rows, matches))
            matches, rank, documents = matches + rows, rank + rows, documents - rows
            top[1], top[2] = top[1] + rows, top[2] - rows
            if not top[2]:
                open_gaps.pop()
        if gaps:
            open_gaps.append([part, 0, gaps])
    return ranges


def _numbered(left: DataFrame, ranges: list[tuple[int, int, int, int]]) -> DataFrame:
    """Add `match` to left-over rows: the number of their match across partitions, or null."""
    by_part: dict[int, list[tuple[int, int, int]]] = {}
    for part, first, rows, match in ranges:
        by_part.setdefault(part, []).append((first, rows, match))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part, number, size, rank in zip(*(c.to_pylist() for c in batch.columns)):
                match = next(
                    (m + rank - a for a, n, m in by_part.get(part, ()) if a <= rank < a + n), None
                )
                yield number, size, match

    return map_batches(left, run, "number bigint, size bigint, match bigint")


def _round(documents: DataFrame, gaps: DataFrame, rows: int) -> DataFrame:
    """One sweep: (what, item, sequence, size); size of what is placed is the gap's before."""
    both = documents.select("size", F.lit(1).alias("is_document"), F.col("item").alias("number"))
    both = both.unionByName(
        gaps.select("size", F.lit(0).alias("is_document"), F.col("sequence").alias("number"))
    )
    order = [F.desc("size"), F.asc("is_document"), F.asc("number")]
    parts = parts_for(documents, rows, ROWS_PER_PART)
    sweep = both.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    swept = map_batches(
        sweep, _local_sweep, "what string, item bigint, sequence bigint, size bigint, rank bigint"
    )
    swept = written(swept.withColumn("part", F.spark_partition_id()), "swept")
    left = swept.filter(F.col("what").isin("document", "gap"))
    counts: dict[int, tuple[int, int]] = {}
    by_part = left.groupBy("part").agg(
        F.count_if(F.col("what") == "document"), F.count_if(F.col("what") == "gap")
    )
    for part, n_documents, n_gaps in by_part.collect():  # one row per partition
        counts[part] = (n_documents, n_gaps)
    ranges = _across(counts)
    sides = {
        side: _numbered(
            left.filter(F.col("what") == side).select(
                "part", F.coalesce("item", "sequence"), "size", "rank"
            ),
            ranges[side],
        )
        for side in ("document", "gap")
    }
    # Rows without a match keep to themselves by their own number, so no key is hot.
    alone = {"document": 1, "gap": 2}
    d, g = (
        sides[x].select(
            F.col("number").alias(f"{x[0]}_number"), F.col("size").alias(f"{x[0]}_size"),
            F.when(F.col("match").isNull(), alone[x]).otherwise(0).alias("kind"),
            F.coalesce("match", "number").alias("match"),
        )
        for x in ("document", "gap")
    )
    met = d.join(g, ["kind", "match"], "full_outer")
    none = F.lit(None).cast("bigint")
    rest = met.select(
        F.when(F.col("d_number").isNull(), F.array(F.struct(
            F.lit("gap").alias("what"), none.alias("item"),
            F.col("g_number").alias("sequence"), F.col("g_size").alias("size"))))
        .when(F.col("g_number").isNull(), F.array(F.struct(
            F.lit("document").alias("what"), F.col("d_number").alias("item"),
            none.alias("sequence"), F.col("d_size").alias("size"))))
        .otherwise(F.array(
            F.struct(F.lit("placed").alias("what"), F.col("d_number").alias("item"),
                     F.col("g_number").alias("sequence"), F.col("g_size").alias("size")),
            F.struct(F.lit("gap").alias("what"), none.alias("item"),
                     F.col("g_number").alias("sequence"),
                     (F.col("g_size") - F.col("d_size")).alias("size")),
        )).alias("rows")
    ).select(F.inline("rows"))
    local = swept.filter(F.col("what").isin("placed", "later")).select(
        F.when(F.col("what") == "later", "gap").otherwise(F.col("what")).alias("what"),
        "item", "sequence", "size",
    )
    # The rows are slim and few: no more files than the sweep is worth.
    return written(local.unionByName(rest.coalesce(parts)).filter("size > 0"), "round")


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every item: item, sequence_id, offset.

    `items` has unique `item` and `size` from 1 to the capacity; it should be a written
    table, as every round reads what the round before has left.
    """
    spark = items.sparkSession
    full = items.filter(F.col("size") == capacity)
    documents = items.filter(F.col("size") < capacity).select("item", "size")
    gaps = spark.createDataFrame([], "sequence bigint, size bigint")
    placed = [full.select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    # Sequences of full items have their numbers; the others are negative.
    opened, at_hand, before = 0, 0, 0
    while True:
        n, total, least = documents.agg(F.count("*"), F.sum("size"), F.min("size")).first()
        if not n:
            break
        gaps = gaps.filter(F.col("size") >= least)
        if before - n <= FEW * n:
            more = math.ceil(total / capacity)
            new = spark.range(opened + 1, opened + more + 1).select(
                (-F.col("id")).alias("sequence"), F.lit(capacity).cast("bigint").alias("size")
            )
            gaps, opened, at_hand = gaps.unionByName(new), opened + more, at_hand + more
        done, before = _round(documents, gaps, n + at_hand), n
        placed.append(done.filter("what = 'placed'").select(
            "item", F.col("sequence").alias("sequence_id"), (capacity - F.col("size")).alias("offset")))
        documents = done.filter("what = 'document'").select("item", "size")
        gaps = done.filter("what = 'gap'").select("sequence", "size")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = document_pieces(docs, path, capacity, end)
    places = best_fit(pieces.select("item", F.col("length").alias("size")), capacity)
    return pieces.join(places, "item").drop("item")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
