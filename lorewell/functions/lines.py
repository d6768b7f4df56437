"""Parsing single lines of the dialogue text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_space(text: Column | str) -> Column:
    """Without blanks at both ends, no-break and other Unicode ones included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def numbered_head(line: Column | str) -> Column:
    """Part before the first tab: turn number and utterance."""
    return F.substring_index(line, "\t", 1)


def numbered_tail(line: Column | str) -> Column:
    """First tab and all after it; empty when there is no tab."""
    line = F.col(line) if isinstance(line, str) else line
    return F.regexp_extract(line, r"(?s)^[^\t]*(\t.*)$", 1)


def numbered_query(line: Column | str, keep_leading_digits: bool = False) -> Column:
    """Utterance of a numbered line.

    By default every leading digit and space goes, so an utterance that opens
    with a number loses it; `keep_leading_digits` removes the turn number only.
    """
    pattern = r"^\d+ " if keep_leading_digits else "^[0-9 ]+"
    return F.regexp_replace(numbered_head(line), pattern, "")


def tab_fields(line: Column | str) -> Column:
    """Tab-separated `key:value` line -> array<struct<key, value>>."""
    return F.transform(
        F.split(line, "\t", -1),
        lambda f: F.struct(
            F.substring_index(f, ":", 1).alias("key"),
            F.when(F.instr(f, ":") > 0, F.substr(f, F.instr(f, ":") + 1))
            .otherwise(F.lit(""))
            .alias("value"),
        ),
    )


def field_value(fields: Column, key: str, first: bool = False) -> Column:
    """Value of a key: the last one by default; null when the key is missing."""
    hits = F.filter(fields, lambda f: f["key"] == key)
    return F.get(hits, F.lit(0) if first else F.size(hits) - 1)["value"]


def unescape_field(value: Column) -> Column:
    """Escapes of the `key:value` format."""
    out = F.replace(value, F.lit("\\t"), F.lit("\t"))
    out = F.replace(out, F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("__PIPE__"), F.lit("|"))


def truncate_words(text: Column | str, n: int, side: str = "right") -> Column:
    """Keep n blank-separated words; `side` is the side that is cut."""
    words = F.split(text, " ", -1)
    if side == "right":
        return F.array_join(F.slice(words, 1, n), " ")
    if side == "left":
        return F.array_join(F.slice(words, F.greatest(F.size(words) - n, F.lit(0)) + 1, n), " ")
    raise ValueError(f"side must be 'left' or 'right', not {side!r}")
