"""Ordered work on groups of any size.

A window over (group, order) puts a whole group into one task, and one file or
conversation may hold a large part of all rows. Here a group is cut into blocks
of its order column; only one small row per block is ever brought together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000


def _block(order: str, block_rows: int) -> Column:
    return F.floor(F.col(order) / F.lit(block_rows)).cast("bigint")


def running(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    block_rows: int = BLOCK_ROWS,
    block: Column | None = None,
) -> DataFrame:
    """Add running sums and maxima, current row included, and `is_last` of the group.

    `order` must be unique in a group. First every block is summed up, then the
    totals of earlier blocks are added to the running values inside a block.
    `block` replaces the default cut; it must rise with `order`.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    values = {**sums, **maxima}
    blocked = df.withColumns(
        {"_block": _block(order, block_rows) if block is None else block}
        | {f"_v_{n}": v for n, v in values.items()}
    )
    totals = blocked.groupBy(*group, "_block").agg(
        F.max(order).alias("_end"),
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxima],
    )
    blocks = W.partitionBy(*group).orderBy("_block")
    before = blocks.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(*group)
    carry = totals.select(
        *group,
        "_block",
        F.max("_end").over(everything).alias("_end"),
        *[F.sum(f"_t_{n}").over(before).alias(f"_b_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_b_{n}") for n in maxima],
    )
    inside = (
        W.partitionBy(*group, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    )
    local = blocked.withColumns(
        {f"_v_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}
        | {f"_v_{n}": F.max(f"_v_{n}").over(inside) for n in maxima}
    )
    joined = local.join(carry, [*group, "_block"])
    out = {n: F.coalesce(f"_b_{n}", F.lit(0)) + F.col(f"_v_{n}") for n in sums}
    out |= {n: F.greatest(f"_b_{n}", f"_v_{n}") for n in maxima}
    out["is_last"] = F.col(order) == F.col("_end")
    helpers = [f"_{p}_{n}" for n in values for p in "vb"]
    return joined.withColumns(out).drop("_block", "_end", *helpers)


def with_reach(
    df: DataFrame, order: str, before: int = 0, after: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cut into blocks by `order`; rows near a border are copied into the next block too.

    Adds `_block` and `_own`. A window over (group, _block) then sees, for every
    row with `_own`, all rows of its group whose order value is at most `before`
    lower or `after` higher. Filter on `_own` afterwards.
    """
    home = _block(order, block_rows)
    low = F.floor((F.col(order) - after) / F.lit(block_rows)).cast("bigint")
    high = F.floor((F.col(order) + before) / F.lit(block_rows)).cast("bigint")
    spread = df.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(low, high)))
    return spread.withColumn("_own", F.col("_block") == F.col("_home")).drop("_home")


def with_neighbour(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    columns: Mapping[str, str],
    step: int = -1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add columns of the row whose order value is exactly `step` away, null if there is none."""
    reach = with_reach(df, order, max(-step, 0), max(step, 0), block_rows)
    at = W.partitionBy(*group, "_block").orderBy(order)
    if abs(step) != 1:
        raise ValueError("step must be 1 or -1")
    near = F.lag if step < 0 else F.lead
    source = F.struct(F.col(order).alias("_o"), *[F.col(c).alias(n) for n, c in columns.items()])
    hit = F.when(near(source, 1).over(at)["_o"] == F.col(order) + step, near(source, 1).over(at))
    found = reach.withColumn("_near", hit).filter("_own")
    return found.withColumns({n: F.col("_near")[n] for n in columns}).drop(
        "_near", "_block", "_own"
    )


def dense_rank_by_digest(df: DataFrame, group: Sequence[str], digest: str, out: str) -> DataFrame:
    """Number the rows of a group from 1 in the order of a hex digest column.

    The digest's first five figures are the blocks, so each is an even share.
    """
    block = F.conv(F.substring(digest, 1, 5), 16, 10).cast("bigint")
    return running(
        df, group, digest, sums={out: F.lit(1).cast("bigint")}, block=block
    ).drop("is_last")
