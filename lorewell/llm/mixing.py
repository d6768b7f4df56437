"""Mixing sources to target weights, by fitting each source's word budget.

Targets: sources in order of name share all words by weight; a target stops at `most` times
its source's words and the excess is shared again. Every document is taken as often as the
target holds its source whole; for the rest documents are counted by exact length, each
length gives its even share, and a bounded-knapsack table over the lengths left fits what
remains. Which documents of a length are taken is decided by a seeded hash.

Only counts per (source, length) come together, never a source's documents; the choice among
documents of one length works on hash buckets, so a frequent length is no hot group.

Null text has size 0 and nothing of it is taken; the null source is a source, last in
order; a null doc_id is carried along. Repeated rows are documents of their own (which of
equal rows is taken does not matter). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.llm.shared import table, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
BUCKETS = 1024
# Words that the knapsack table spans at most; more is taken in whole lengths first.
TABLE = 1 << 16


def words(column: str = "text") -> Column:
    """Number of runs of characters other than space and \\t to \\r."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row per source, from `source` and `size`.

    The common rate r solves sum(min(most * size, r * weight)) = all words: sources sorted by
    the rate at which they are full, the first that is not full at its own rate tells.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Windows over all sources: one small row each.
    number = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    rated = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    everything = W.partitionBy()
    full_at = W.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = full_at.rowsBetween(W.unboundedPreceding, -1)
    rate = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ) / F.sum("weight").over(full_at.rowsBetween(0, W.unboundedFollowing))
    own = rated.withColumn("rate", rate)
    holds = F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rate"))
    first = F.min(holds).over(everything)
    return own.withColumn("common", first["rate"]).select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight")).alias("target"),
    )


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come to the budget.

    An even share of every length first; then whole documents, longest first, while more
    than TABLE words are missing; then a bounded-knapsack table for the rest, which ends
    at the fullest sum within the budget.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    left = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths):
        if left <= TABLE:
            break
        more = min(int(counts[i] - taken[i]), (left - TABLE) // int(lengths[i]) + 1, left // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    # Bits of `sums` are reachable sums; each step remembers which sums it added.
    limit, sums = (1 << (left + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for i in np.argsort(lengths):
        length, room = int(lengths[i]), int(counts[i] - taken[i])
        if length > left:
            break
        times, room = 1, min(room, left // length)
        while room and not sums >> left & 1:
            times = min(times, room)
            new = (sums << length * times) & limit & ~sums
            if new:
                steps.append((i, times, new))
                sums |= new
            room -= times
            times *= 2
    at = sums.bit_length() - 1
    for i, times, new in reversed(steps):
        if new >> at & 1:
            taken[i] += times
            at -= times * int(lengths[i])
    return taken


def plan_lengths(by_length: DataFrame, targets: DataFrame) -> DataFrame:
    """source, size, whole (copies of every document), extra (documents of this length).

    `by_length` has source, size and n; a group is the distinct lengths of a source.
    """

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        target, all_words = rows["target"].iloc[0], rows["source_size"].iloc[0]
        whole, lengths = 0, rows["size"].to_numpy(np.int64)
        extra = np.zeros(len(rows), np.int64)
        if all_words > 0:
            whole = int(target // all_words)
            some = lengths > 0
            extra[some] = fit_budget(
                lengths[some], rows["n"].to_numpy(np.int64)[some], int(round(target - whole * all_words))
            )
        return pd.DataFrame({"source": rows["source"], "size": lengths, "whole": whole, "extra": extra})

    rows = by_length.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
    return rows.groupBy("source").applyInPandas(
        fitted, "source string, size bigint, whole bigint, extra bigint"
    )


def mix_sources(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """Add source_size, target and `copies` (how often the mix takes the document).

    `sizes`: a written table with doc_id, source (string), size and `digest`, a hash of what
    tells rows apart. Other columns are kept.
    """
    targets = written(source_targets(sizes, weights, most), "targets").withColumnRenamed("source", "t_source")
    draw = F.xxhash64(F.lit(seed), "digest", "doc_id")
    drawn = sizes.withColumn("draw", draw).withColumn("bucket", F.pmod(F.shiftrightunsigned("draw", 40), F.lit(BUCKETS)))
    counts = written(drawn.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "counts")
    by_length = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    plan = plan_lengths(by_length, targets)
    # At most BUCKETS rows per source and length.
    before = W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    edges = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    key = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("s", key[0]).withColumn("no_s", key[1]).drop("source")

    edges = keyed(edges).join(keyed(plan), ["s", "no_s", "size"]).drop("n")
    # `before` of a bucket tells how many of its first documents are still needed.
    edges = edges.select(
        "s", "no_s", "size", "bucket", "whole", (F.col("extra") - F.col("before")).alias("need")
    )
    rank = F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy("draw", "digest"))
    ranked = drawn.withColumn("rank", rank).withColumn("s", key[0]).withColumn("no_s", key[1])
    chosen = ranked.join(edges, ["s", "no_s", "size", "bucket"]).withColumn(
        "copies", F.col("whole") + (F.col("rank") <= F.col("need")).cast("bigint")
    )
    targets = targets.withColumn("s", F.coalesce("t_source", F.lit(""))).withColumn(
        "no_s", F.col("t_source").isNull()
    )
    return chosen.join(targets, ["s", "no_s"]).drop(
        "s", "no_s", "t_source", "bucket", "draw", "rank", "whole", "need"
    )


def document_sizes(docs: DataFrame, *also: str) -> DataFrame:
    """Written slim rows of the documents: doc_id, source, size, digest."""
    return written(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
            words().alias("size"), F.xxhash64("text").alias("digest"), *also,
        ), "sizes",
    )


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(document_sizes(table(spark, sf_dir, "documents")))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )
