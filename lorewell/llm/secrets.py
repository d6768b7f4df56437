"""Secrets in whole texts: keyword automaton, anchored expressions at its hits, checksums.

One Aho-Corasick pass over the lower-cased text finds the keywords of all kinds; for runs of
hex digits these are all four-digit strings. An expression is tried only where a keyword of
its kind begins, on the original text, left to right and past the last match: as every match
begins with a keyword, this is the leftmost non-overlapping search. Tokens that carry a
checksum (`github`, `npm`) count only if it is right: CRC-32 of the 30 characters before it,
in base 62.

Null text is empty and has no secrets; a null doc_id stays null; repeated rows come back
once each; an empty table gives no rows. Spans are code points, end exclusive. Long texts
are scanned whole, and one at a time.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.shared import map_batches, one_model, slices, table, text_of

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
}
HEX_KEYWORD = 4
MASK = "[SECRET]"
_either_case = "(?:password|passwd|secret|token|api_?key)"
PATTERNS = {
    "assign": re.compile(
        f"(?ai:{_either_case})" r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
    "github": re.compile("gh[pousr]_([A-Za-z0-9]+)"),
    "npm": re.compile("npm_([A-Za-z0-9]+)"),
}
DIGITS = string.digits + string.ascii_uppercase + string.ascii_lowercase
CHECKED = 30
_LOWER = {ord(x): x.lower() for x in string.ascii_uppercase}


def checksum(body: str) -> str:
    """CRC-32 in base 62, six digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out


def _holds(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[1]) >= 8
    if kind == "access":
        return len(match[0]) >= 16
    if kind == "hex":
        return len(match[0]) >= 32
    body = match[1]
    return len(body) == CHECKED + 6 and body[CHECKED:] == checksum(body[:CHECKED])


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All keywords, each with its length and its kind's number."""
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (len(word), KINDS.index(kind)))
    for digits in product("0123456789abcdef", repeat=HEX_KEYWORD):
        found.add_word("".join(digits), (HEX_KEYWORD, KINDS.index("hex")))
    found.make_automaton()
    return found


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every secret, sorted."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower case is longer
        lowered = text.translate(_LOWER)
    hits: list[list[int]] = [[] for _ in KINDS]
    for last, (size, kind) in automaton().iter(lowered):
        hits[kind].append(last + 1 - size)
    spans = []
    for kind, starts in enumerate(hits):
        pattern, past = PATTERNS[KINDS[kind]], 0
        for start in sorted(starts):
            if start >= past and (match := pattern.match(text, start)):
                past = match.end()
                if _holds(KINDS[kind], match):
                    spans.append((start, kind, past))
    return sorted(spans)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str) -> str:
    """The text with every secret masked; overlapping spans are masked together."""
    out, past = [], 0
    for start, _, end in find_secrets(text):
        if start >= past:
            out += [text[past:start], MASK]
        past = max(past, end)
    return "".join(out) + text[past:]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in slices(batches):
            for name, text in zip(*part):
                spans = find_secrets(text)
                base = [x for x in spans if x[1] < BASE]
                counts = [sum(x[1] == kind for x in base) for kind in range(BASE)]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                yield name, *counts, digest, _joined(spans)

    return map_batches(
        docs.select(F.col("doc_id").cast("bigint"), text_of()), run,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    )


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns with secrets masked in `text`; null text stays null."""

    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_model()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                masked = [x if x is None else redact(x) for x in part.column(at).to_pylist()]
                field = part.schema.field(at)
                yield part.set_column(at, field, pa.array(masked, field.type))

    return docs.mapInArrow(run, schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
