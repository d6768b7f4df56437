"""Fill-in-middle transformation, cut at units found by a wavelet matrix.

The code points of a batch of texts become one sequence of character classes; a class says
what kind a character is and whether it opens a word, a line or neither. A wavelet matrix
over that sequence answers "how many characters of a class stand before place i" (rank).
A unit (character, word, line) is a set of opening classes, so the number of its boundaries
before a place is a sum of ranks, and the place where the j-th unit begins is found by
bisection on that sum, for all cuts of the batch side by side.

Two draws give the cuts, one the form, all from a hash of `seed` and doc_id:

* `psm`:   `<P>` prefix `<S>` suffix `<M>` middle
* `spm`:   `<S>` suffix `<P>` prefix `<M>` middle
* `plain`: the text; always for empty texts and for those that hold a mark

Null text counts as empty; a null doc_id is hashed as an empty name. Repeated rows come back
once each, with equal results. Texts are never cut into parts: a very long one is a batch
of its own. Columns other than doc_id and text are not read; an empty table gives no rows.
Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.pretokens import chunks
from lorewell.llm.shared import map_batches, slices, table, text_of

MARKS = ("<P>", "<S>", "<M>")
PLAIN_SHARE, SPM_SHARE = 10, 20
BATCH_CHARS = 4_000_000
# Classes: 4 * kind + 2 if the character opens a line + 1 if it opens a word.
WORD_KIND, SPACE_KIND, BREAK_KIND, OTHER_KIND = range(4)
BITS = 4
OPENS = {
    "char": tuple(range(16)),
    "word": tuple(c for c in range(16) if c & 1),
    "line": tuple(c for c in range(16) if c & 2),
}


@lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """Kind of every code point: letters and digits, spaces, line breaks, others."""
    kinds = np.full(0x110000, OTHER_KIND, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalnum():
            kinds[code] = WORD_KIND
        elif c.isspace():
            kinds[code] = SPACE_KIND
    kinds[0x0A] = BREAK_KIND
    return kinds


def class_sequence(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all characters, one text after the other, and where each text begins."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    kinds = character_kinds()[codes]
    first = np.zeros(len(codes), bool)
    first[starts[:-1][sizes > 0]] = True
    before = np.empty_like(kinds)
    before[1:] = kinds[:-1]
    before[:1] = OTHER_KIND
    # a word is a run of letters and digits, or any other visible character by itself
    word = (kinds == OTHER_KIND) | ((kinds == WORD_KIND) & (first | (before != WORD_KIND)))
    line = first | (before == BREAK_KIND)
    return (kinds * 4 + line * 2 + word).astype(np.uint8), starts


class WaveletMatrix:
    """Bit levels of a sequence of small numbers, with counts of ones per word of 64 bits."""

    def __init__(self, values: np.ndarray, bits: int = BITS):
        self.size, self.bits = len(values), bits
        self.words: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            padded = np.zeros(-(-(self.size + 1) // 64) * 64, np.uint8)
            padded[: self.size] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            self.words.append(words)
            self.ones.append(ones)
            self.zeros.append(self.size - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, places: np.ndarray) -> np.ndarray:
        """Ones of a level before each place."""
        at, rest = places >> 6, (places & 63).astype(np.uint64)
        below = self.words[level][at] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.ones[level][at] + np.bitwise_count(below)

    def rank(self, values: Sequence[int], first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """How many of `values` stand at places first <= i < last, for all pairs at once.

        One rank per value, all added up; values that share leading bits share the way down.
        """
        total = np.zeros(len(first), np.int64)
        todo = [(0, frozenset(values), first, last)]
        while todo:
            level, wanted, low, high = todo.pop()
            if level == self.bits:
                total += high - low
                continue
            half = 1 << (self.bits - level - 1)
            ones_low, ones_high = self._ones(level, low), self._ones(level, high)
            left = frozenset(v for v in wanted if v < half)
            right = frozenset(v - half for v in wanted if v >= half)
            if left:
                todo.append((level + 1, left, low - ones_low, high - ones_high))
            if right:
                zeros = self.zeros[level]
                todo.append((level + 1, right, zeros + ones_low, zeros + ones_high))
        return total


def place_of(
    matrix: WaveletMatrix, opens: Sequence[int], first: np.ndarray, last: np.ndarray, units: np.ndarray
) -> np.ndarray:
    """Place in each text before which exactly `units` whole units have begun and ended.

    That is where unit number `units` (from 0) opens, the start for 0, the end of the text if
    it has no more: the greatest place with at most `units` openings before it, by bisection.
    """
    low, high = first.copy(), last.copy()
    while (open_ := low < high).any():
        middle = (low + high + 1) >> 1
        fits = matrix.rank(opens, first, middle) <= units
        low = np.where(open_ & fits, middle, low)
        high = np.where(open_ & ~fits, middle - 1, high)
    return np.where(units == 0, first, low)


def cuts(texts: Sequence[str], draws: np.ndarray, unit: str = "char") -> tuple[np.ndarray, np.ndarray]:
    """Units of every text, and two places (in code points) from two draws, smaller first."""
    classes, starts = class_sequence(texts)
    matrix = WaveletMatrix(classes)
    first, last = starts[:-1], starts[1:]
    units = matrix.rank(OPENS[unit], first, last)
    drawn = np.sort(draws.reshape(-1, 2) % (units + 1)[:, None], axis=1)
    places = [place_of(matrix, OPENS[unit], first, last, drawn[:, i]) - first for i in (0, 1)]
    return units, np.stack(places, axis=1)


def draws_of(seed: str, doc_id: Column) -> list[Column]:
    """Four numbers below 2^32 from the hash of `seed:doc_id`."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(name, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: str = "1") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of every document.

    `unit` is char, word or line: cuts fall between two of them. `prefix_chars` and
    `middle_chars` count code points and are null for plain texts.
    """
    h = draws_of(seed, F.col("doc_id"))
    text = text_of()
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (h[2] % 100 >= 100 - PLAIN_SHARE)
    form = F.when(plain, "plain").when(h[3] % 100 < SPM_SHARE, "spm").otherwise("psm")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), h[0].alias("h1"), h[1].alias("h2"),
        form.alias("form"), text.alias("text"),
    )
    p, s, m = MARKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for names, h1, h2, forms, texts in slices(batches, 2_000):
            at = 0
            for group in chunks(texts, BATCH_CHARS):
                own = slice(at, at + len(group))
                draws = np.array([h1[own], h2[own]], np.int64).T
                units, places = cuts(group, draws, unit)
                for i, (text, n, (a, b)) in enumerate(zip(group, units.tolist(), places.tolist())):
                    kind = forms[at + i]
                    if kind == "plain":
                        yield names[at + i], n, kind, None, None, text
                        continue
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    head = f"{p}{prefix}{s}{suffix}" if kind == "psm" else f"{s}{suffix}{p}{prefix}"
                    yield names[at + i], n, kind, a, b - a, f"{head}{m}{middle}"
                at += len(group)

    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return map_batches(rows, run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one was made from; exact, as no text holds a mark."""
    parts = F.split(output, "|".join(MARKS), -1)
    prefix = F.when(form == "psm", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2)))
    suffix = F.when(form == "psm", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = """WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4
  FROM (SELECT *, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents)),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
part AS (
  SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid,
    substring(text, b + 1, n - b) AS suf FROM cut)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM part"""
