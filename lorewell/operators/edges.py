"""From raw assertions to the edge table that lookups use."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorewell.functions import porter2
from lorewell.functions.labels import concept_label, concept_prefix, relation_token

# Relations that say little about the world.
EXCLUDED_RELATIONS = ("/r/Synonym", "/r/Antonym", "/r/DerivedFrom")


def english_edges(assertions: DataFrame, lang: str = "en") -> DataFrame:
    """Keep assertions with both ends in one language."""
    prefix = concept_prefix(lang)
    return assertions.filter(
        F.col("start_uri").startswith(prefix) & F.col("end_uri").startswith(prefix)
    )


def with_weight(assertions: DataFrame) -> DataFrame:
    """Read the weight out of the metadata; null when it is missing or no number."""
    weight = F.get_json_object("extra", "$.weight").try_cast("double")
    return assertions.withColumn("weight", weight)


def without_weight(weighted: DataFrame) -> DataFrame:
    """Quarantine: rows whose metadata holds no usable weight."""
    return weighted.filter(F.col("weight").isNull())


def min_weight(weighted: DataFrame, at_least: float = 1.0) -> DataFrame:
    return weighted.filter(F.col("weight") >= at_least)


def with_labels(edges: DataFrame, lang: str = "en") -> DataFrame:
    """Add `start` and `end`, which are generated: else what uses them makes them again each time."""
    labels = F.struct(
        concept_label("start_uri", lang).alias("start"), concept_label("end_uri", lang).alias("end")
    )
    others = [c for c in edges.columns if c not in ("start", "end")]
    return edges.select(*others, F.inline(F.array(labels)))


# Workers get the stemmer with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(porter2)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(StringType())
def _stem(labels: pd.Series) -> pd.Series:
    known = {x: porter2.stem(x) for x in labels.dropna().unique()}
    return pd.Series([known.get(x) for x in labels], dtype=object)


def stem_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels with their stems."""
    return labels.select(label).distinct().withColumn("stem", _stem(label))


def _first_letter(label: str) -> Column:
    plain = F.regexp_replace(F.lower(label), "^['’‘‛]", "")
    return F.substring(plain, 1, 1)


def drop_same_stem(edges: DataFrame) -> DataFrame:
    """Drop edges whose two labels have the same stem.

    Stemming never touches the first letter, so labels that open differently
    cannot share a stem, and equal labels always do. Only what is left goes to
    the Python worker; nothing is shuffled.
    """
    same_letter = _first_letter("start") == _first_letter("end")
    open_case = same_letter & (F.col("start") != F.col("end"))
    marked = edges.withColumns(
        {
            "_start_stem": _stem(F.when(open_case, F.col("start"))),
            "_end_stem": _stem(F.when(open_case, F.col("end"))),
        }
    )
    kept = F.when(open_case, F.col("_start_stem") != F.col("_end_stem")).otherwise(
        F.col("start") != F.col("end")
    )
    return marked.filter(kept).drop("_start_stem", "_end_stem")


def relation_share(edges: DataFrame) -> DataFrame:
    """Edges per relation and their share in percent.

    The window runs over one row per relation, after the count.
    """
    counts = edges.groupBy("relation").agg(F.count("*").alias("n"))
    share = F.col("n") * F.lit(100.0) / F.sum("n").over(W.partitionBy())
    return counts.withColumn("share", F.concat(F.round(share, 1).cast("string"), F.lit("%")))


def top_relations(
    edges: DataFrame, n: int = 16, exclude: Sequence[str] = EXCLUDED_RELATIONS
) -> DataFrame:
    """The n most frequent relations, less the excluded ones; those are not replaced."""
    counts = edges.groupBy("relation").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "relation").limit(n)
    return top.filter(~F.col("relation").isin(list(exclude)))


def relation_special_tokens(relations: DataFrame) -> DataFrame:
    return relations.select("relation", relation_token("relation").alias("token"))


def restrict_relations(edges: DataFrame, relations: DataFrame | Sequence[str]) -> DataFrame:
    """Keep edges of the given relations; a table is joined, a list is a filter."""
    if isinstance(relations, DataFrame):
        return edges.join(relations.select("relation"), "relation", "left_semi")
    return edges.filter(F.col("relation").isin(list(relations)))


def collapse_edges(labelled: DataFrame, order_col: str | Column = "uri") -> DataFrame:
    """One edge per (start, end): the last one in the given order wins."""
    known = labelled.filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    last = F.max_by(F.struct("relation", "weight"), order_col)
    return (
        known.groupBy("start", "end")
        .agg(last.alias("last"))
        .select("start", "end", "last.relation", "last.weight")
    )


def drop_inverse_pairs(triples: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Of (a, r, b) and (b, r, a) within a scope keep the one with the smaller start."""
    low, high = F.least("start", "end"), F.greatest("start", "end")
    others = [c for c in triples.columns if c not in (*scope, "relation", "start", "end")]
    pick = F.min(F.struct("start", "end", *others)).alias("kept")
    return (
        triples.withColumns({"_low": low, "_high": high})
        .groupBy(*scope, "relation", "_low", "_high")
        .agg(pick)
        .select(*scope, "kept.start", "relation", "kept.end", *[f"kept.{c}" for c in others])
    )
