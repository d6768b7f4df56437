"""Connected components by alternating large and small stars.

Every round replaces links by links to a smaller neighbour, until each node hangs on the
smallest node of its component; rounds grow with the logarithm of the longest path. Rounds
are written, so a lost executor costs a read. Minima are aggregated before they are
shuffled; the join of a hub with its minimum is one Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.shared import written


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One star step over links (u > v): every node's neighbours move to its smallest one."""
    there = links.select(F.col("u").alias("a"), F.col("v").alias("b"))
    both = there if small else there.unionByName(links.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(least, "a")
    if small:
        moved = met.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("u"),
                           F.col("m").alias("v"))
    else:
        moved = met.filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    return moved.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of links (u, v); any order, any repeats.

    Rows with a null end and links of a node with itself are left out; nodes that have no
    other link are not listed.
    """
    links = written(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "links",
    )
    mark = None
    while True:
        links = written(_star(_star(links, small=False), small=True), "stars")
        now = links.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        ).first()
        if now == mark:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select("v", "v").distinct().toDF("node", "component")
            )
        mark = now
