"""Near-duplicates by SimHash fingerprints and tables of distances to pivots.

Fingerprints are those of the whole lower-cased text. Equal fingerprints are one class, so
copies never meet. The distinct ones get a table of Hamming distances to fixed reference
fingerprints (pivots). Two fingerprints at most `bits` apart agree wholly on some
two of bits + 2 blocks, so each is placed once per pair of blocks; rows that meet there are
compared in order of the first pivot's distance: pairs whose distances to any pivot differ
by more than `bits` are discarded, the rest verified. A place gives back only a forest of
its links, which is enough for components, and a place with too many rows for one task is
dealt out as pairs of slices, so nothing is left out.

Null text is empty. Texts without words have fingerprint zero, linked like any other. A
null doc_id is carried along and never names a component unless all of it is null.
Repeated rows come back once each. An empty table gives no rows. Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.components import components
from lorewell.llm.pretokens import encoder
from lorewell.llm.shared import map_batches, shuffle_partitions, slices, table, text_of, written

SHINGLE = 4
BITS = 4
PIVOTS = 24
SLICE = 4_000



def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the hashes of the shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        parts = [line]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
        cuts = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())
        parts = [line[a:b] for a, b in cuts]
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64, len(parts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        octets = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (64 bits in a bigint) and the columns `also` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder.cache_clear()  # a worker keeps one model at a time
        for *names, texts in slices(batches):
            for *row, text in zip(*names, texts):
                value = fingerprint(text, shingle)
                yield *row, value - (1 << 64) if value >> 63 else value

    kept = ["doc_id", *also]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return map_batches(docs.select(*kept, text_of()), run, f"{kinds}, fp bigint")


def pivots(number: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of the numbers, so the same on every machine."""
    return np.array([xxhash.xxh64_intdigest(str(i), 0) for i in range(number)], np.uint64)


def _joined(left: np.ndarray, right: np.ndarray, bits: int, same: bool) -> Iterator[tuple[int, int]]:
    """A forest of the links between two lists of fingerprints (or inside one list)."""
    table_of = [np.bitwise_count(x[:, None] ^ pivots()[None, :]).astype(np.int16) for x in (left, right)]
    order = [np.argsort(t[:, 0], kind="stable") for t in table_of]
    (a, ta), (b, tb) = ((x[o], t[o]) for x, t, o in zip((left, right), table_of, order))
    low = np.searchsorted(tb[:, 0], ta[:, 0] - bits, "left")
    high = np.searchsorted(tb[:, 0], ta[:, 0] + bits, "right")
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(a)):
        begin = max(int(low[i]), i + 1) if same else int(low[i])
        near = np.arange(begin, high[i])
        for first in range(1, ta.shape[1], 8):
            far = np.abs(tb[near, first : first + 8] - ta[i, first : first + 8]).max(1, initial=0)
            near = near[far <= bits]
            if not len(near):
                break
        near = near[np.bitwise_count(b[near] ^ a[i]) <= bits]
        for j in near.tolist():
            x, y = int(a[i]), int(b[j])
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[rx] = ry
                yield x, y


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_links(distinct: DataFrame, bits: int = BITS, slice_rows: int = SLICE) -> DataFrame:
    """Links (u, v) that connect the same fingerprints as all pairs at most `bits` apart.

    `distinct`: a written table of distinct `fp`.
    """
    blocks = bits + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    pairs = [_signed(masks[a] | masks[b]) for a, b in combinations(range(blocks), 2)]
    placed = distinct.select(
        "fp",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("pair"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
            for i, m in enumerate(pairs)
        ])).alias("place"),
    ).select("fp", "place.*")
    sizes = placed.groupBy("pair", "key").agg(F.count("*").alias("n")).filter("n > 1")
    placed = placed.join(sizes, ["pair", "key"])
    slices = F.ceil(F.col("n") / F.lit(slice_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), slices).cast("int")
    # A slice meets itself and every other: its rows go to each pair of slices it is part of.
    dealt = placed.withColumns({"slices": slices, "own": own}).select(
        "fp", "pair", "key", "own",
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"),
    ).select("fp", "pair", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    group = ["pair", "key", "lo", "hi"]
    sorted_places = dealt.repartition(shuffle_partitions(distinct), *group).sortWithinPartitions(*group)

    def links(rows: list[tuple[int, int]], lo: int, hi: int) -> Iterator[tuple]:
        values = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        sides = np.array([r[1] for r in rows], np.int64)
        left, right = values[sides == lo], values[sides == hi]
        for x, y in _joined(left, right, bits, same=lo == hi):
            yield _signed(x), _signed(y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, rows = None, []
        for batch in batches:
            for fp, pair, key, own_slice, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                if (pair, key, lo, hi) != now:
                    if len(rows) > 1:
                        yield from links(rows, now[2], now[3])
                    now, rows = (pair, key, lo, hi), []
                rows.append((fp, own_slice))
        if len(rows) > 1:
            yield from links(rows, now[2], now[3])

    return map_batches(sorted_places, run, "u bigint, v bigint")


def near_classes(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """fp, class: the fingerprints' classes, for a written table with `fp`.

    Fingerprints without a link are not listed.
    """
    distinct = written(prints.select("fp").distinct(), "fingerprints")
    return components(near_links(distinct, bits)).select(
        F.col("node").alias("fp"), F.col("component").alias("class")
    )


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id of the class) of every row."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    prints = written(fingerprints(docs, shingle), "prints")
    classed = prints.join(near_classes(prints, bits), "fp", "left").withColumn(
        "class", F.coalesce("class", "fp")
    )
    # Least per fingerprint first: large groups of copies shrink before they are joined.
    least = classed.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return classed.join(least, "class").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
