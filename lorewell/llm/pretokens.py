"""Pre-tokens by array operations, and ids of whole texts through a dictionary of pre-tokens.

Byte-pair merges never cross a pre-token. So the tokenizers library encodes every distinct
pre-token of a worker once, and a text's ids are those of its pre-tokens in order. Texts
that hold a special string, or that the normaliser would change twice, go to the library
whole. `tests/llm` compares all of this with the library.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd

from lorewell.llm.shared import model

LETTER, NUMBER, SPACE, OTHER, BREAK = range(5)
# The characters of the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Beyond these blocks classes change between versions of Unicode.
RARE = re.compile("[\u0370-\U0010ffff]")
CHUNK_CHARS = 1_000_000
CACHED = 500_000


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def _contractions(codes: np.ndarray, starts: np.ndarray) -> None:
    """'s 't 'm 'd 're 've 'll are tokens of their own where a token begins."""
    at = np.flatnonzero(starts & (codes == 0x27))
    at = at[at + 1 < len(codes)]
    one = codes[at + 1]
    two = codes[np.minimum(at + 2, len(codes) - 1)]
    s, t, m, d, r, v, e, ell = (ord(x) for x in "stmdrvel")
    short = at[(one == s) | (one == t) | (one == m) | (one == d)]
    long = at[((one == r) | (one == v)) & (two == e) | (one == ell) & (two == ell)]
    for hits, size in ((short, 2), (long, 3)):
        starts[hits + 1] = False
        ends = hits + size
        starts[ends[ends < len(codes)]] = True


def _spans(texts: list[str], spaced: bool) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined text, its code points, starts, ends, text number) of all pre-tokens."""
    joined = "\x00".join(texts) + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends_of_texts = np.cumsum([len(x) + 1 for x in texts]) - 1
    kinds = character_classes()[codes]
    kinds[ends_of_texts] = BREAK
    starts = np.empty(len(codes), bool)
    starts[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    starts[ends_of_texts] = True
    starts[ends_of_texts[:-1] + 1] = True
    if spaced:
        # The last blank before a word joins the word if it is a space, else it stands alone.
        last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & (kinds[1:] != BREAK))
        starts[last] = True
        starts[last[codes[last] == 0x20] + 1] = False
    else:
        starts[kinds == NUMBER] = True
    _contractions(codes, starts)
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], len(codes))
    wanted = kinds[begin] != BREAK
    if not spaced:
        wanted &= kinds[begin] != SPACE
    begin, end = begin[wanted], end[wanted]
    return joined, codes, begin, end, np.searchsorted(ends_of_texts, begin)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def _digests(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of every span; spans over 64 characters get one of their own."""
    base = 0x9E3779B97F4A7C15
    room = 1 << (len(codes) - 1).bit_length()
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * _powers(base, room)[: len(codes)], out=sums[1:])
    digest = (sums[end] - sums[begin]) * _powers(pow(base, -1, 1 << 64), room)[begin]
    long = np.flatnonzero(end - begin > 64)
    digest[long] = ~long.astype(np.uint64)  # one character has a small one
    return digest


def split_pretokens(
    texts: list[str], spaced: bool = True
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens; then for every occurrence, in order, its number there and its text.

    `spaced`: the pattern with leading spaces and runs of numbers; else the one that
    drops white space and takes numbers one by one. Long pre-tokens may be listed twice.
    """
    if not texts:
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    joined, codes, begin, end, owner = _spans(texts, spaced)
    number, distinct = pd.factorize(_digests(codes, begin, end))
    first = np.empty(len(distinct), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return [joined[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())], number, owner


def chunks(texts: Iterable[str], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Consecutive lists of texts of about `limit` characters; no text is cut."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > limit:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


class PretokenIds:
    """Ids of texts for one tokenizer file; keeps the ids of up to `cached` pre-tokens."""

    def __init__(self, path: str, cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.spaced = self.library.normalizer is None
        self.cached = cached
        self.trust: dict[str, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.begin = np.zeros(1, np.int64)

    def _learn(self, new: list[str], known: int) -> None:
        coded: list[list[int]] = []
        for i in range(0, len(new), 4_000):  # encodings are large objects
            part = self.library.encode_batch_fast(new[i : i + 4_000], add_special_tokens=False)
            coded += [x.ids for x in part]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter((i for x in coded for i in x), np.uint32, int(sizes.sum()))
        self.numbers.update((x, known + i) for i, x in enumerate(new))
        self.flat = np.concatenate([self.flat, ids])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])

    def _places(self, tokens: list[str]) -> np.ndarray:
        """Where the ids of each pre-token are; those not met before are learned."""
        if len(self.numbers) + len(tokens) > self.cached:
            self._clear()
        known = len(self.numbers)
        place = np.array([*map(self.numbers.setdefault, tokens, repeat(-1))], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            distinct = list(dict.fromkeys([tokens[i] for i in new]))
            self._learn(distinct, known)
            place[new] = np.fromiter(map(self.numbers.__getitem__, (tokens[i] for i in new)), np.int64, len(new))
        return place

    def _trusted(self, char: str) -> bool:
        """Does the library class this character as we do? Newer letters may differ."""
        if char not in self.trust:
            probe = f"a{char}b 1{char}2 .{char}. {char}'s"
            self.trust[char] = True
            ours = self.encode([probe])[0].tolist()
            theirs = self.library.encode(probe, add_special_tokens=False).ids
            self.trust[char] = ours == theirs
        return self.trust[char]

    def normal(self, text: str) -> str | None:
        """The text as the library's normaliser leaves it; None: only the library can tell."""
        if any(x in text for x in self.specials):
            return None
        if not text.isascii() and not all(map(self._trusted, set(RARE.findall(text)))):
            return None
        if self.spaced:
            return text
        lowered = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return lowered if unicodedata.is_normalized("NFC", lowered) else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without added special tokens."""
        normal = [self.normal(x) for x in texts]
        whole = [i for i, x in enumerate(normal) if x is None]
        tokens, number, owner = split_pretokens(["" if x is None else x for x in normal], self.spaced)
        place = self._places(tokens)
        found = place[number]
        first, sizes = self.begin[found], self.begin[found + 1] - self.begin[found]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        ids = self.flat[np.repeat(first - after + sizes, sizes) + np.arange(total)]
        cuts = np.searchsorted(owner, np.arange(1, len(texts)))
        bounds = np.concatenate([[0], after])[cuts]
        out = np.split(ids, bounds) if texts else []
        if whole:
            coded = self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
            for i, x in zip(whole, coded):
                out[i] = np.array(x.ids, np.uint32)
        return out


@model
@lru_cache(maxsize=4)
def encoder(path: str) -> PretokenIds:
    """One encoder per worker process and file."""
    return PretokenIds(path)
