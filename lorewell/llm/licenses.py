"""License scans by a positional index of rare words.

A template is a license notice as a list of words, with a key phrase inside it that must
stand word for word. How rare a licence word is, is counted over all documents. The index
holds, for every template, the places of the rarest words of its key phrase. A file's
licence words are looked up there, rarest ones only: each says at which word of the file
the notice would begin. Where the words of a template agree on that relative position the
key phrase is verified word by word, and the notice counts if the words that stand at their
places hold at least `SHARE` per cent of its rarity. The three base phrases are templates
that consist of nothing but their key phrase, so every place of theirs is found: a phrase
cannot stand anywhere without its rarest words.

`score` is the largest such share of a file, 1 for a whole notice, 0 if there is none.

Null text counts as empty: no words, no label, score 0. Repeated rows come back once each; a
null doc_id stays null. Texts are read whole; a very long one is a batch of its own. Columns
other than doc_id and text are not read. An empty table gives no rows. Only the counts of the
licence words are shuffled, one row for each of them and task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.pretokens import chunks
from lorewell.llm.shared import map_batches, slices, table, text_of

SHARE = 60
RARE = 2
BATCH_CHARS = 2_000_000
KEY_BYTES = 16
# Label, key phrase, notice (empty: the key phrase alone). The first three are
# the base phrases.
BASE = (
    ("cc-by", "cc by", ""),
    ("gpl", "general public license", ""),
    ("reserved", "all rights reserved", ""),
)
NOTICES = (
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met"),
    ("cc-by", "creative commons attribution 4 0",
     "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc0", "waived all copyright",
     "to the extent possible under law the author has waived all copyright and related or "
     "neighboring rights to this work"),
    ("gpl-2.0", "general public license version 2",
     "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "general public license version 3",
     "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software",
     "permission to use copy modify and or distribute this software for any purpose with or "
     "without fee is hereby granted"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files"),
    ("mpl-2.0", "mozilla public license",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


@dataclass(frozen=True)
class Template:
    label: str
    base: bool
    words: tuple[str, ...]
    key: tuple[int, int]  # first and last place of the key phrase, end exclusive


def templates() -> list[Template]:
    out = []
    for base, entries in ((True, BASE), (False, NOTICES)):
        for label, phrase, notice in entries:
            key, words = phrase.split(), (notice or phrase).split()
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            out.append(Template(label, base, tuple(words), (at, at + len(key))))
    return out


def vocabulary(known: Sequence[Template]) -> list[str]:
    return sorted({w for t in known for w in t.words})


def _keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of words of up to KEY_BYTES bytes, padded by zeros, as two numbers each."""
    places = np.arange(KEY_BYTES)
    taken = data[np.minimum(starts[:, None] + places, len(data) - 1)]
    taken[places >= sizes[:, None]] = 0
    return np.ascontiguousarray(taken).view("<u8")


class WordCodes:
    """Tells the licence words among all words of a batch of texts."""

    def __init__(self, words: Sequence[str]):
        self.folded = np.arange(256, dtype=np.uint8)
        self.folded[0x41:0x5B] += 0x20
        self.inside = np.zeros(256, bool)
        self.inside[0x30:0x3A] = self.inside[0x61:0x7B] = self.inside[0x80:] = True
        coded = [w.encode() for w in words]
        self.longest = max(map(len, coded))
        if self.longest > KEY_BYTES:
            raise ValueError(f"template words may have at most {KEY_BYTES} bytes")
        flat = np.frombuffer(b"".join(coded), np.uint8)
        sizes = np.array(list(map(len, coded)))
        keys = _keys(flat, np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(self._mixed(keys), kind="stable")
        self.mixed, self.keys, self.numbers = self._mixed(keys)[order], keys[order], order

    @staticmethod
    def _mixed(keys: np.ndarray) -> np.ndarray:
        return keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)

    def code(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of every word, -1 if it is none of the vocabulary; first word of each text.

        The second array has one entry more than there are texts.
        """
        coded = [x.encode("utf-8", "surrogatepass") for x in texts]
        data = self.folded[np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)]
        inside = self.inside[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        starts, ends = edges[::2], edges[1::2]
        sizes = ends - starts
        out = np.full(len(starts), -1, np.int32)
        short = np.flatnonzero(sizes <= self.longest)
        keys = _keys(data, starts[short], sizes[short])
        at = np.minimum(np.searchsorted(self.mixed, self._mixed(keys)), len(self.mixed) - 1)
        same = (self.keys[at] == keys).all(1)
        out[short[same]] = self.numbers[at[same]]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        return out, np.searchsorted(starts, offsets)


def document_frequencies(docs: DataFrame, words: Sequence[str]) -> tuple[int, list[int]]:
    """Number of documents, and in how many of them each word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        coder, total, counts = WordCodes(words), 0, np.zeros(len(words), np.int64)
        for (texts,) in slices(batches, 2_000):
            for group in chunks(texts, BATCH_CHARS):
                codes, first = coder.code(group)
                hits = np.flatnonzero(codes >= 0)
                owners = np.searchsorted(first, hits, side="right") - 1
                pairs = np.unique(owners * len(words) + codes[hits])
                counts += np.bincount(pairs % len(words), minlength=len(words))
                total += len(group)
        yield from ((i, n) for i, n in enumerate([*counts.tolist(), total]) if n)

    counted = map_batches(docs.select(text_of().alias("text")), run, "word int, n bigint")
    sums = {x.word: x.n for x in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # one row a word
    return sums.get(len(words), 0), [sums.get(i, 0) for i in range(len(words))]


def rarity(total: int, counts: Sequence[int]) -> list[int]:
    """Whole-numbered inverse document frequency: the bits of (total + 1) / (count + 1)."""
    return [((total + 1) // (n + 1)).bit_length() for n in counts]


class RareWordIndex:
    """Postings of the rarest key words of every template, by word."""

    def __init__(self, known: Sequence[Template], rare: Sequence[int]):
        self.known, words = known, vocabulary(known)
        number = {w: i for i, w in enumerate(words)}
        self.codes = [np.array([number[w] for w in t.words]) for t in known]
        self.weight = [np.array(rare)[c] for c in self.codes]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        self.need: list[int] = []
        for i, t in enumerate(known):
            places = sorted(range(*t.key), key=lambda j: (-self.weight[i][j], j))[:RARE]
            self.need.append(len(places))
            for j in places:
                self.postings.setdefault(int(self.codes[i][j]), []).append((i, j))

    def find(self, codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Template, first words of its places, and the shares found there (as weights)."""
        hits = np.flatnonzero(codes >= 0)
        hits = hits[np.argsort(codes[hits], kind="stable")]
        ranked = codes[hits]
        starts: dict[int, list[np.ndarray]] = {}
        for word, postings in self.postings.items():
            low, high = np.searchsorted(ranked, [word, word + 1])
            for i, place in postings:
                starts.setdefault(i, []).append(hits[low:high] - place)
        for i, lists in sorted(starts.items()):
            agreed, votes = np.unique(np.concatenate(lists), return_counts=True)
            at = agreed[votes == self.need[i]]
            key = np.arange(*self.known[i].key)
            # the key phrase must lie inside one text; a rest of the notice may be cut off
            owner = np.searchsorted(first, at + key[0], side="right") - 1
            inside = (at + key[0] >= 0) & (at + key[-1] < first[np.minimum(owner + 1, len(first) - 1)])
            at, owner = at[inside], owner[inside]
            verified = (codes[at[:, None] + key] == self.codes[i][key]).all(1)
            at, owner = at[verified], owner[verified]
            places = at[:, None] + np.arange(len(self.codes[i]))
            there = (places >= first[owner][:, None]) & (places < first[owner + 1][:, None])
            same = codes[np.clip(places, 0, len(codes) - 1)] == self.codes[i] if len(at) else there
            mass = ((there & same) * self.weight[i]).sum(1)
            enough = mass * 100 >= SHARE * self.weight[i].sum()
            yield i, at[enough], mass[enough]


def scan_licenses(docs: DataFrame, known: Sequence[Template] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    `places` lists label:first:last of all notices found, in words, end exclusive, in order.
    """
    known = templates() if known is None else known
    words = vocabulary(known)
    total, counts = document_frequencies(docs, words)
    rare = rarity(total, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        coder, index = WordCodes(words), RareWordIndex(known, rare)
        for names, texts in slices(batches, 2_000):
            at = 0
            for group in chunks(texts, BATCH_CHARS):
                codes, first = coder.code(group)
                found: list[list[tuple[int, int, int, float]]] = [[] for _ in group]
                for i, starts, mass in index.find(codes, first):
                    whole, key = int(index.weight[i].sum()), known[i].key[0]
                    owners = np.searchsorted(first, starts + key, side="right") - 1
                    for owner, start, held in zip(owners.tolist(), starts.tolist(), mass.tolist()):
                        found[owner].append((i, start - int(first[owner]), held, held / whole))
                for j, (hits, n) in enumerate(zip(found, np.diff(first).tolist())):
                    yield names[at + j], n, *_row(known, hits, n)
                at += len(group)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return map_batches(
        rows, run,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double, places string",
    )


def _row(known: Sequence[Template], hits: list[tuple[int, int, int, float]], n: int) -> tuple:
    base = [(start, known[i].label) for i, start, _, _ in hits if known[i].base]
    starts = [s for s, _ in base]
    spans = sorted((max(0, s), min(n, s + len(known[i].words)), known[i].label) for i, s, _, _ in hits)
    return (
        len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({x for _, x in base})), ",".join(sorted({known[i].label for i, *_ in hits})),
        max((share for *_, share in hits), default=0.0),
        ",".join(f"{label}:{a}:{b}" for a, b, label in spans),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("places")


def _sql_templates() -> str:
    rows = []
    for i, t in enumerate(templates()):
        for j, w in enumerate(t.words):
            key = t.key[0] <= j < t.key[1]
            rows.append(f"({i}, '{t.label}', {t.base}, {t.key[1] - t.key[0]}, {j}, {key}, '{w}')")
    return ", ".join(rows)


OP12_SQL = f"""WITH t(i, label, base, keys, j, key, w) AS (VALUES {_sql_templates()}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
word AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d),
known AS (SELECT rid, w, p FROM word WHERE w IN (SELECT w FROM t)),
df AS (SELECT w, count(DISTINCT rid) AS n FROM known GROUP BY w),
rare AS (
  SELECT w, length(bin(((SELECT count(*) FROM d) + 1) // (coalesce(n, 0) + 1))) AS idf
  FROM (SELECT DISTINCT w FROM t) LEFT JOIN df USING (w)),
weighed AS (SELECT t.*, idf, sum(idf) OVER (PARTITION BY i) AS whole FROM t JOIN rare USING (w)),
notice AS (
  SELECT rid, i, any_value(label) AS label, any_value(base) AS base, p - j AS start,
    sum(idf) AS mass, any_value(whole) AS whole
  FROM known JOIN weighed USING (w) GROUP BY rid, i, p - j
  HAVING count(*) FILTER (key) = any_value(keys) AND sum(idf) * 100 >= {SHARE} * any_value(whole)),
found AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
    max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(CAST(mass AS DOUBLE) / CAST(whole AS DOUBLE)) AS score
  FROM notice GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN found USING (rid)"""
