"""Writing and reading the text cells that carry knowledge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewell.functions.labels import triple_key, triple_text

# Markers that the dialogue formats expect.
OPEN_MARK = "__knowledge__"
CLOSE_MARK = "__endknowledge__"
COMMA_MARK = "_comma_"
PIPE_MARK = "_pipe_"


def envelope(body: Column) -> Column:
    return F.concat(F.lit(OPEN_MARK), body, F.lit(CLOSE_MARK))


def escape_separators(text: Column) -> Column:
    """A comma would break comma-split lines, a pipe would break the list form."""
    return F.replace(
        F.replace(text, F.lit(","), F.lit(COMMA_MARK)), F.lit("|"), F.lit(PIPE_MARK)
    )


def unescape_commas(text: Column) -> Column:
    return F.replace(text, F.lit(COMMA_MARK), F.lit(","))


def unescape_separators(text: Column) -> Column:
    return F.replace(unescape_commas(text), F.lit(PIPE_MARK), F.lit("|"))


def _form(form: str) -> Callable[[Column], Column]:
    make = {"key": triple_key, "text": triple_text}[form]
    return lambda t: make(t["start"], t["relation"], t["end"])


def render_enveloped(triples: Column | str, form: str = "key", escape: bool = True) -> Column:
    """One envelope per triple, nothing between them."""
    one = _form(form)
    clean = escape_separators if escape else (lambda c: c)
    return F.array_join(F.transform(triples, lambda t: envelope(clean(one(t)))), "")


def render_list(triples: Column | str, separator: str = "|", form: str = "text") -> Column:
    """Items joined by a separator, no envelope."""
    one = _form(form)
    clean = escape_separators if separator == "|" else (lambda c: c)
    return F.array_join(F.transform(triples, lambda t: clean(one(t))), separator)


def parse_items(cell: Column | str) -> Column:
    """Knowledge cell of either generation -> array<string>."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    text = F.coalesce(cell, F.lit(""))
    enveloped = F.regexp_extract_all(text, F.lit(f"{OPEN_MARK}(.*?){CLOSE_MARK}"), F.lit(1))
    listed = F.filter(F.split(text, "\\|", -1), lambda x: x != "")
    return F.when(F.contains(text, F.lit(OPEN_MARK)), enveloped).otherwise(listed)


def append_knowledge(text: Column, items: Column, skip_empty: bool = False) -> Column:
    """Append items to an utterance as one envelope on a new line."""
    body = F.array_join(items, ". ")
    full = F.concat(text, F.lit("\n"), envelope(body))
    return F.when(F.size(items) > 0, full).otherwise(text) if skip_empty else full
