"""Concepts of JSON episodes brought back into the line format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions import lines as L
from lorewell.functions.knowledge_text import escape_separators


def concepts_by_text(episodes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(text, concepts): of equal texts the last wins; an entry without partner is dropped.

    Equal texts combine before the shuffle, however many there are.
    """
    both = F.least(F.size("dialog"), F.size("concepts"))
    entries = F.arrays_zip(
        F.slice("dialog", 1, both).alias("entry"), F.slice("concepts", 1, both).alias("concepts")
    )
    rows = episodes.select(*order, F.posexplode(entries).alias("pos", "e")).select(
        *order,
        "pos",
        F.get(F.col("e")["entry"], F.lit(1)).alias("text"),
        F.col("e")["concepts"].alias("concepts"),
    )
    return rows.groupBy("text").agg(
        F.max_by("concepts", F.struct(*order, "pos")).alias("concepts")
    )


def backport_concepts(
    lines: DataFrame, episodes: DataFrame, order: tuple[str, ...] = ("file", "episode_id")
) -> DataFrame:
    """Lines with a `concepts` field from the episodes.

    Lines without `free_message` are dropped, one with several gives several.
    `found` is false where no episode has the text: that is the quarantine.
    """
    mark = "free_message:"
    messages = F.filter(F.split("line", "\t", -1), lambda f: f.startswith(mark))
    asked = lines.select("*", F.posexplode(messages).alias("field_no", "field"))
    asked = asked.withColumn("text", F.replace("field", F.lit(mark), F.lit("")))
    joined = asked.join(concepts_by_text(episodes, order), "text", "left")
    cut = F.substring_index("line", "\tconcepts:", 1)
    listed = F.array_join(F.transform("concepts", escape_separators), "|")
    return joined.select(
        "file",
        "line_no",
        F.col("field_no").cast("bigint").alias("field_no"),
        F.when(
            F.col("concepts").isNotNull(),
            F.concat(L.strip_space(cut), F.lit("\tconcepts:"), listed),
        ).alias("line"),
        F.col("concepts").isNotNull().alias("found"),
    )
