"""Expressions over concept and relation URIs and over triples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concept_prefix(lang: str = "en") -> str:
    return f"/c/{lang}/"


def concept_label(uri: Column | str, lang: str = "en") -> Column:
    """Readable label of a concept URI, without part of speech and sense.

    A URI of another language gives null.
    """
    uri = F.col(uri) if isinstance(uri, str) else uri
    raw = F.regexp_extract(uri, concept_prefix(lang) + "(.*?)(/|$)", 1)
    return F.when(raw != "", F.replace(raw, F.lit("_"), F.lit(" ")))


def relation_name(relation: Column | str) -> Column:
    relation = F.col(relation) if isinstance(relation, str) else relation
    return F.replace(relation, F.lit("/r/"), F.lit(""))


def relation_token(relation: Column | str) -> Column:
    """`/r/IsA` -> `__IsA__`."""
    return F.concat(F.lit("__"), relation_name(relation), F.lit("__"))


def relation_phrase(relation: Column | str) -> Column:
    """`/r/MotivatedByGoal` -> `Motivated By Goal`."""
    return F.btrim(F.regexp_replace(relation_name(relation), "([A-Z]+)", " $1"))


def triple_key(start: Column | str, relation: Column | str, end: Column | str) -> Column:
    """`c__Rel__n`, the offline form of a triple."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return F.concat(start, relation_token(relation), end)


def triple_text(start: Column | str, relation: Column | str, end: Column | str) -> Column:
    """`c Rel Name n`, the sentence form of a triple."""
    return F.concat_ws(" ", start, relation_phrase(relation), end)


def parse_triple(key: Column | str) -> Column:
    """`c__Rel__n` back to a struct; null when the text has another form."""
    parts = F.split(key, "__")
    return F.when(
        F.size(parts) == 3,
        F.struct(
            parts[0].alias("start"),
            F.concat(F.lit("/r/"), parts[1]).alias("relation"),
            parts[2].alias("end"),
        ),
    )
