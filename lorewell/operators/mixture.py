"""Mixing datasets by weight, dialogue history and truncation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.functions.lines import truncate_words
from lorewell.operators.ordered import BLOCK_ROWS, dense_rank_by_digest, running, with_reach

# Training mixture and text limits of the two model sizes.
LARGE_MIXTURE = {"bst": 1, "wow": 3, "convai": 3, "empathy": 3}
SMALL_MIXTURE = {"bst": 1, "wow": 3, "convai": 3}
LARGE_LIMITS = {"text": 128, "label": 128}
SMALL_LIMITS = {"text": 512, "label": 128}
COPIES_AT_ONCE = 10_000


def mix_datasets(
    examples: DataFrame,
    weights: Mapping[str, int] = LARGE_MIXTURE,
    key: str = "id",
    seed: int = 0,
    total: int | None = None,
    positions: bool = False,
) -> DataFrame:
    """Draw from each `dataset` its share of `total`, by default as many rows as there are.

    A dataset larger than its share gives the rows with the lowest digests; a
    smaller one repeats all rows as often as needed, then those first ones once
    more. `copy` counts the repeats from 0. Rows are ranked by digest blocks, so
    a dataset need not fit a task. With `positions` every row gets its `position` (from 0) in an
    order that holds the weights all along.
    """
    listed = examples.filter(F.col("dataset").isin(list(weights)))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    ranked = dense_rank_by_digest(
        listed.withColumn("_d", digest), ["dataset"], "_d", "_place"
    ).drop("_d")
    sizes = listed.groupBy("dataset").agg(F.count("*").alias("_size"))
    wanted = (
        F.lit(total).cast("bigint")
        if total is not None
        else F.sum("_size").over(W.partitionBy())
    )
    weight = F.element_at(
        F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("dataset")
    )
    quota = F.floor(wanted * weight / F.lit(sum(weights.values()))).cast("bigint")
    # at most one row per dataset name in `weights`
    quotas = sizes.select("dataset", "_size", quota.alias("_quota"))
    if positions:
        all_quotas = F.collect_list(F.struct("dataset", "_quota")).over(W.partitionBy())
        quotas = quotas.withColumn("_quotas", all_quotas)
    quotas = F.broadcast(quotas)
    full = F.floor(F.col("_quota") / F.col("_size"))
    extra = (F.col("_place") <= F.col("_quota") % F.col("_size")).cast("bigint")
    rows = ranked.join(quotas, "dataset").withColumn("_copies", full + extra).filter("_copies > 0")
    # In two steps, so that no row holds an array of all its repeats.
    step = F.lit(COPIES_AT_ONCE).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, step)
    spread = rows.withColumn("_from", F.explode(starts))
    last = F.least(F.col("_from") + step, F.col("_copies")) - 1
    copied = spread.withColumn("copy", F.explode(F.sequence("_from", last)))
    if positions:
        rank = F.col("copy") * F.col("_size") + F.col("_place") - 1
        copied = copied.withColumn("position", interleaved_position(rank)).drop("_quotas")
    return copied.drop("_place", "_size", "_quota", "_copies", "_from")


def interleaved_position(rank: Column) -> Column:
    """Place of a dataset's row number `rank` (from 0) among the rows of all datasets.

    Row r of a dataset with quota q stands at (r + 1/2) / q of the way, ties by dataset name; so
    any stretch holds of each dataset its share to within a row or two. How many rows of
    another dataset come before follows from whole numbers, and nothing is sorted for it. Needs
    `dataset`, its `_quota`, and `_quotas`, those of all datasets.
    """
    odd = (rank * 2 + 1).cast("decimal(20,0)")

    def before(other: Column) -> Column:
        # rows s with (2s + 1) * quota < (2 rank + 1) * other quota, or <= for an earlier name
        reach = odd * other["_quota"].cast("decimal(18,0)")
        whole = F.call_function("div", reach, F.col("_quota"))
        exact = whole.cast("decimal(19,0)") * F.col("_quota").cast("decimal(18,0)") == reach
        below = F.when(exact & (other["dataset"] > F.col("dataset")), whole - 1).otherwise(whole)
        rows = F.call_function("div", below + 1, F.lit(2))
        return F.when(other["dataset"] == F.col("dataset"), rank).otherwise(rows)

    return F.aggregate("_quotas", F.lit(0).cast("bigint"), lambda acc, q: acc + before(q))


def training_order(mixed: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows spread by stretches of `position`, in order inside each; write them as they are."""
    spread = (
        mixed.repartitionByRange(parts, "position") if parts else mixed.repartitionByRange("position")
    )
    return spread.sortWithinPartitions("position")


def history_text(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    delimiter: str = "  ",
    end_token: str | None = "__end__",
    max_words: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add `history`: all turns up to this one, joined.

    With `max_words` the history is cut to its last words. A turn takes one place at
    least, so no more than `max_words` turns can be seen; turns are counted first, and
    a conversation of any length is cut into blocks of that count. Without it the
    result itself grows with the square of a conversation.
    """
    if max_words is None:
        frame = W.partitionBy(conv).orderBy(turn).rowsBetween(W.unboundedPreceding, 0)
        return turns.withColumn("history", _joined_history(text, frame, delimiter, end_token))
    placed = running(
        turns, [conv], turn, sums={"_place": F.lit(1).cast("bigint")}, block_rows=block_rows
    ).drop("is_last")
    blocked = with_reach(placed, "_place", before=max_words, block_rows=block_rows)
    frame = W.partitionBy(conv, "_block").orderBy("_place").rangeBetween(-max_words, 0)
    history = truncate_words(_joined_history(text, frame, delimiter, end_token), max_words, "left")
    return blocked.withColumn("history", history).filter("_own").drop("_own", "_block", "_place")


def _joined_history(text: str, frame, delimiter: str, end_token: str | None) -> Column:
    # a null turn is an empty one, as a collected list would leave it out
    said = F.collect_list(F.coalesce(text, F.lit(""))).over(frame)
    joined = F.array_join(said, delimiter)
    return F.concat(joined, F.lit(delimiter + end_token)) if end_token else joined


def truncate_examples(
    examples: DataFrame, limits: Mapping[str, int] = LARGE_LIMITS, text_side: str = "left"
) -> DataFrame:
    """Cut `text` and `label` to their limits in words."""
    return examples.withColumns(
        {
            "text": truncate_words("text", limits["text"], text_side),
            "label": truncate_words("label", limits["label"], "right"),
        }
    )
