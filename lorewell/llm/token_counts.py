"""Token counts of whole texts, from the pieces of each distinct pre-token.

Each document becomes pre-token frequencies, packed by batch of documents and by shard of the
pre-token dictionary. A shard meets all batches in one place: there a pre-token's pieces are
counted once and joined to the frequencies, and the partial sums go back to the batches.
Ids are never kept. Two shuffles move only distinct pre-tokens per batch and sums.

Null text is empty and has no tokens; a null doc_id stays null; repeated rows come back once
each; an empty table gives no rows; columns other than doc_id and text are not read. Special
strings inside a text count as one token, as the library has it. The table must be read
from files, or written first: batches are known by their place in it.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.pretokens import CACHED, chunks, encoder, split_pretokens
from lorewell.llm.shared import (
    map_batches, shuffle_partitions, slices, table, text_of, tokenizer_path,
)

LIMIT = 1024
# At least so many shards of the dictionary, and four per partition, so that hashing spreads them.
SHARDS = 256
# Characters of the documents that share one list of distinct pre-tokens.
BATCH_CHARS = 3_000_000
PACKED = (
    "shard int, batch bigint, packed binary, "
    "names array<bigint>, sizes array<bigint>, fixed array<bigint>"
)


def _narrow(values: np.ndarray) -> np.ndarray:
    """In the narrowest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _frequencies(path: str, shards: int):
    """Rows of PACKED: for each shard its distinct pre-tokens and (document, times) of each."""

    def pack(coder, batch: int, names: list, texts: list[str]) -> Iterator[tuple]:
        cut = re.compile("|".join(map(re.escape, coder.specials)) or "(?!)")
        fixed = np.zeros(len(texts), np.int64)
        parts, owner_of = [], []
        for i, text in enumerate(texts):
            found = cut.split(text)
            fixed[i] = len(found) - 1
            for part in found:
                normal = coder.normal(part)
                if normal is None:  # characters that this Python and the library class apart
                    fixed[i] += len(coder.library.encode(part, add_special_tokens=False).ids)
                elif normal:
                    parts.append(normal)
                    owner_of.append(i)
        press = zstandard.ZstdCompressor(level=3)
        header = names, [len(x.encode()) for x in texts], fixed.tolist()
        tokens, number, part = split_pretokens(parts, coder.spaced)
        if not tokens:
            yield 0, batch, None, *header
            return
        pair, times = np.unique(
            number * len(texts) + np.array(owner_of, np.int64)[part], return_counts=True
        )
        token, document = np.divmod(pair, len(texts))
        shard = np.fromiter((zlib.crc32(x.encode()) % shards for x in tokens), np.int64, len(tokens))
        by_shard = np.argsort(shard, kind="stable")
        spread = np.bincount(token, minlength=len(tokens))
        order = np.argsort(shard[token], kind="stable")  # pairs are sorted by token already
        document, times = _narrow(document[order]), _narrow(times[order])
        spread = _narrow(spread)
        ends = np.searchsorted(shard[by_shard], np.arange(shards), "right")
        pair_ends = np.cumsum(np.bincount(shard[token], minlength=shards))
        begin = pair_begin = 0
        for k in range(shards):
            end, pair_end = int(ends[k]), int(pair_ends[k])
            if end > begin:
                own = by_shard[begin:end]
                content = (
                    [tokens[i] for i in own], spread[own], document[pair_begin:pair_end], times[pair_begin:pair_end]
                )
                yield k, batch, press.compress(pickle.dumps(content, 5)), *header
                header = None, None, None
            begin, pair_begin = end, pair_end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        coder = encoder(path)
        number = TaskContext.get().partitionId() << 33
        for names, texts in slices(batches, 2_000):
            done = 0
            for group in chunks(texts, BATCH_CHARS):
                yield from pack(coder, number, names[done : done + len(group)], group)
                number, done = number + 1, done + len(group)

    return run


def _counted(path: str, cached: int = CACHED):
    """Join a shard's pre-tokens with their numbers of pieces; sums per batch and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        library, press = encoder(path).library, zstandard.ZstdDecompressor()
        squeeze = zstandard.ZstdCompressor(level=3)
        pieces: dict[str, int] = {}
        now, sums, header = None, np.zeros(0), (None, None, None)

        def result() -> tuple:
            return now, squeeze.compress(pickle.dumps(_narrow(sums.astype(np.int64)), 5)), *header

        for rows in batches:
            for row in rows.to_pylist():
                if row["batch"] != now:
                    if now is not None:
                        yield result()
                    now, sums, header = row["batch"], np.zeros(0), (None, None, None)
                if row["names"] is not None:
                    header = row["names"], row["sizes"], row["fixed"]
                if row["packed"] is None:
                    continue
                tokens, spread, docs, times = pickle.loads(press.decompress(row["packed"]))
                new = [x for x in tokens if x not in pieces]
                if len(pieces) + len(new) > cached:
                    pieces.clear()
                    new = tokens
                coded = library.encode_batch_fast(new, add_special_tokens=False)
                pieces.update((x, len(y.ids)) for x, y in zip(new, coded))
                counts = np.fromiter(map(pieces.__getitem__, tokens), np.int64, len(tokens))
                more = np.bincount(docs, np.repeat(counts, spread) * times.astype(np.int64))
                if len(more) < len(sums):
                    more, sums = sums, more
                more[: len(sums)] += sums
                sums = more
        if now is not None:
            yield result()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sums of all shards per document; rows of a batch follow each other."""
    press = zstandard.ZstdDecompressor()
    now, total, header = None, np.zeros(0, np.int64), (None, None, None)

    def result() -> Iterator[tuple]:
        names, sizes, fixed = header
        out = np.array(fixed, np.int64)
        out[: len(total)] += total
        yield from zip(names, sizes, out.tolist())

    for rows in batches:
        for batch, packed, *head in zip(*(c.to_pylist() for c in rows.columns)):
            if batch != now:
                if now is not None:
                    yield from result()
                now, total, header = batch, np.zeros(0, np.int64), (None, None, None)
            if head[0] is not None:
                header = tuple(head)
            sums = pickle.loads(press.decompress(packed))
            if len(sums) > len(total):
                total = np.concatenate([total, np.zeros(len(sums) - len(total), np.int64)])
            total[: len(sums)] += sums
    if now is not None:
        yield from result()


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    parts = shuffle_partitions(docs)
    packed = map_batches(
        docs.select(F.col("doc_id").cast("bigint"), text_of()),
        _frequencies(path, max(SHARDS, 4 * parts)), PACKED,
    )
    by_shard = packed.repartition(parts, "shard").sortWithinPartitions("batch")
    partial = map_batches(
        by_shard, _counted(path),
        "batch bigint, packed binary, names array<bigint>, sizes array<bigint>, fixed array<bigint>",
    )
    by_batch = partial.repartition(parts, "batch").sortWithinPartitions("batch")
    counts = map_batches(by_batch, _summed, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
