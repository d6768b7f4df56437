"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text tells how far a text can be followed. A
text is parsed into phrases, each the longest that the language's text holds; the byte that
breaks one begins the next. Phrases times the bits of a pointer into that text, per byte,
estimate the cross entropy. The language that needs fewest bits wins. Texts are parsed in
pieces of `WIDTH` bytes, all pieces of a batch side by side as array steps; a phrase ends
with its piece.

Learning uses a bounded sample: of every language `SAMPLE` documents, drawn by a hash of
doc_id, a piece of each from a place drawn likewise over its whole text, and REFERENCE bytes of
these in all (fewer for many languages, so that all automata stay below `ENTRIES` transitions, but
at least LEAST). Prediction reads every whole text, and only the text.

Null text, and text without a letter, is `und` with score 0, as is everything when no
language could be learned. A null doc_id is neither learned from nor held out. Repeated
rows come back once each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.llm.pretokens import chunks
from lorewell.llm.shared import map_batches, model, one_model, slices, table

UNKNOWN = "und"
SAMPLE = 200
REFERENCE = 32_000
LEAST = 1_024
SAMPLE_CHARS = 2_000
ENTRIES = 1 << 24
WIDTH = 512
# Every letter matches; so do a few numerals, which `lettered` sorts out.
LETTER = re.compile(r"[^\W\d_]")


def lettered(text: str) -> bool:
    """Does the text hold a letter?"""
    first = LETTER.search(text)
    return bool(first) and (first[0].isalpha() or any(c.isalpha() for c in text))


def held_out() -> Column:
    """Is the remainder of crc32(doc_id as text) by 4 equal to 2? Null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of every state; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for byte in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at >= 0 and byte not in moves[at]:
            moves[at][byte] = new
            at = link[at]
        if at >= 0:
            to = moves[at][byte]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                link.append(link[to])
                size.append(size[at] + 1)
                link[to] = link[new] = copy
                while at >= 0 and moves[at].get(byte) == to:
                    moves[at][byte] = copy
                    at = link[at]
        last = new
    return moves


class CrossParser:
    """Phrases that a text needs in each language's reference text."""

    def __init__(self, references: tuple[tuple[str, bytes], ...]):
        self.names = [name for name, _ in references]
        folded = [self._folded(text) for _, text in references]
        present = sorted(set().union(*map(set, folded)))
        # Class 0 pads, class 1 is for bytes that no reference has.
        self.classes = np.ones(256, np.uint8)
        self.classes[present] = np.arange(len(present)) + 2
        ascii_rest = [i for i in range(128) if not chr(i).isalpha()]
        self.classes[ascii_rest] = self.classes[0x20]
        self.width = len(present) + 2
        self.bits = np.array([math.log2(max(2, len(x))) for x in folded])
        self.tables = [self._table(suffix_automaton(x)) for x in folded]

    @staticmethod
    def _folded(text: bytes) -> bytes:
        return bytes(x if x >= 128 or chr(x).isalpha() else 0x20 for x in text)

    def _table(self, moves: list[dict[int, int]]) -> np.ndarray:
        """Flat table of state * width + class, holding the next state * width, or -1."""
        table = np.full((len(moves), self.width), -1, np.int32)
        for state, to in enumerate(moves):
            if to:
                table[state, self.classes[list(to)]] = np.array(list(to.values())) * self.width
        table[:, 0] = np.arange(len(moves)) * self.width
        return table.ravel()

    def bits_per_byte(self, texts: list[str]) -> np.ndarray:
        """One row per text, one column per language; texts must not be empty."""
        coded = [x.lower().encode("utf-8", "surrogatepass") for x in texts]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        rows = -(-sizes // WIDTH)
        first = np.cumsum(rows) - rows
        steps = np.zeros(int(rows.sum()) * WIDTH, np.uint8)
        flat = self.classes[np.frombuffer(b"".join(coded), np.uint8)]
        offset = np.repeat(first * WIDTH - (np.cumsum(sizes) - sizes), sizes)
        steps[np.arange(len(flat)) + offset] = flat
        steps = np.ascontiguousarray(steps.reshape(-1, WIDTH).T)
        out = np.empty((len(texts), len(self.names)))
        for i, table in enumerate(self.tables):
            begin = np.maximum(table[: self.width], 0)
            state = np.zeros(steps.shape[1], np.int32)
            phrases = np.ones(steps.shape[1], np.int32)  # the last one, cut by the end
            for byte in steps:
                state = table[state + byte]
                broken = np.flatnonzero(state < 0)
                phrases[broken] += 1
                state[broken] = begin[byte[broken]]
            out[:, i] = np.add.reduceat(phrases, first) * self.bits[i] / sizes
        return out

    def predict(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        bits = self.bits_per_byte(texts)
        best = bits.argmin(1)
        lowest = bits[np.arange(len(texts)), best]
        bits[np.arange(len(texts)), best] = np.inf
        second = bits.min(1) if bits.shape[1] > 1 else np.full(len(texts), np.inf)
        score = np.clip(1 - lowest / second, 0, 1)
        yield from zip([self.names[i] for i in best], score.tolist())


@model
@lru_cache(maxsize=1)
def parser(references: tuple[tuple[str, bytes], ...]) -> CrossParser:
    """Built once per worker process from the few kilobytes of text that a task carries."""
    return CrossParser(references)


def learn_references(
    docs: DataFrame, sample: int = SAMPLE, size: int = REFERENCE
) -> tuple[tuple[str, bytes], ...]:
    """Labelled text per language, from documents that are not held out."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(
        F.col("lang").cast("string").alias("name"), "doc_id", F.col("text").cast("string").alias("text")
    )
    counts = labelled.groupBy("name").agg(F.count("*").alias("n")).collect()  # one row per language
    if not counts:
        return ()
    spark = docs.sparkSession
    rates = spark.createDataFrame(
        [(x.name, min(1.0, 2.0 * sample / x.n)) for x in counts], "name string, rate double"
    )
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    places = F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), places) + 1
    first = W.partitionBy("name").orderBy("draw", "doc_id", "piece")
    drawn = (
        labelled.withColumn("draw", draw).join(F.broadcast(rates), "name").filter("draw < rate")
        .select("name", "draw", "doc_id", F.substring("text", place, F.lit(SAMPLE_CHARS)).alias("piece"))
        .withColumn("at", F.row_number().over(first)).filter(F.col("at") <= 2 * sample)
        .select("name", "draw", F.col("piece").alias("text"))
        .collect()  # at most 2 * sample pieces of SAMPLE_CHARS for each language
    )
    size = min(size, max(LEAST, ENTRIES // (2 * 128 * len(counts))))
    references = []
    for name in sorted(x.name for x in counts):
        texts = dict.fromkeys(x.text for x in sorted(x for x in drawn if x.name == name))
        own = [x.lower().encode("utf-8", "surrogatepass") for x in texts if lettered(x)]
        share = max(200, size // max(1, min(len(own), sample)))
        joined = b" ".join(x[:share] for x in own)[:size]
        if joined:
            references.append((name, joined))
    return tuple(references)


def _guesses(texts: list[str | None], references: tuple[tuple[str, bytes], ...]) -> list[tuple[str, float]]:
    out = []
    for group in chunks((x or "" for x in texts), limit=2_000_000):
        guesses = [(UNKNOWN, 0.0)] * len(group)
        known = [i for i, x in enumerate(group) if references and lettered(x)]
        if known:
            for i, guess in zip(known, parser(references).predict([group[i] for i in known])):
                guesses[i] = guess
        out += guesses
    return out


def keep_known(docs: DataFrame, references: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """The rows whose language can be told, `lang` filled in where it is null.

    Columns are passed on as they are; `docs` has text and lang as strings.
    """
    schema = docs.schema
    at = schema.fieldNames().index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_model(parser)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                names = [name for name, _ in _guesses(part.column("text").to_pylist(), references)]
                kind = part.column(at).type
                lang = pc.coalesce(part.column(at), pa.array(names, kind))
                known = pa.array([name != UNKNOWN for name in names])
                yield part.set_column(at, part.schema.field(at), lang).filter(known)

    return docs.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, references: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        one_model(parser)
        for names, flags, texts in slices(batches):
            for name, held, guess in zip(names, flags, _guesses(texts, references)):
                yield name, held, *guess

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"),
    )
    return map_batches(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, learn_references(docs))
