"""Token ids in Arrow files of fixed-size lists, and their way back.

Documents are sorted by doc_id over all partitions; each partition writes one file. A file
is a row of sequences of `length` ids with a mask of the same shape, in record batches of
`rows` sequences: so the place of any sequence follows from its number, and a memory-mapped
file gives it without a copy. Only the last sequence of a file is padded (mask false). A
second file has the documents: doc_id, first id in the file, number of ids. The manifest, a
table with one row per file, names the files of the attempts that counted; files of lost
attempts are in no manifest.

Null text is empty: the end id alone. A null doc_id comes first; rows of equal doc_id are in
the order of their text's hash. An empty table gives an empty manifest. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.llm.pretokens import chunks, encoder
from lorewell.llm.shared import (
    map_batches, scratch_path, shuffle_partitions, slices, table, text_of, tokenizer_path, written,
)

END = 1
LENGTH = 2048
ROWS = 64
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it of a folder that all machines share."""
    return pafs.FileSystem.from_uri(path)


def _sequences(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Appends ids and closes with a padded sequence."""

    def __init__(self, sink, kind: pa.DataType, length: int, rows: int):
        self.schema = _sequences(kind, length)
        self.dtype, self.length, self.full = kind.to_pandas_dtype(), length, length * rows
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.full:
            flat = np.concatenate(self.held).astype(self.dtype)
            cut = len(flat) // self.full * self.full
            for i in range(0, cut, self.full):
                self._write(flat[i : i + self.full], self.full)
            self.held, self.size = [flat[cut:]], len(flat) - cut

    def _write(self, ids: np.ndarray, valid: int) -> None:
        mask = np.arange(len(ids)) < valid
        self.out.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)],
            schema=self.schema,
        ))

    def close(self) -> None:
        if self.size:
            ids = np.concatenate(self.held).astype(self.dtype)
            room = -(-len(ids) // self.length) * self.length
            self._write(np.pad(ids, (0, room - len(ids))), len(ids))
        self.out.close()


class SequenceReader:
    """Sequences and ids of one file, memory-mapped where the file is local."""

    def __init__(self, path: str):
        store, place = _store(path)
        local = isinstance(store, pafs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(place) if local else store.open_input_file(place))
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.now, self.flat = -1, np.empty(0, np.uint32)

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of a sequence; the ids are a view of the file."""
        batch = self.file.get_batch(number // self.rows)
        row = number % self.rows
        return (
            batch.column("ids")[row].values.to_numpy(),
            batch.column("mask")[row].values.to_numpy(zero_copy_only=False),
        )

    def ids(self, start: int, size: int) -> Iterator[np.ndarray]:
        """The ids from `start` on, in views of at most one record batch."""
        full = self.length * self.rows
        while size:
            batch, begin = divmod(start, full)
            if batch != self.now:
                self.flat = self.file.get_batch(batch).column("ids").flatten().to_numpy()
                self.now = batch
            part = self.flat[begin : begin + size]
            yield part
            start, size = start + len(part), size - len(part)


def write_token_files(
    docs: DataFrame, path: str, root: str, end: int = END, length: int = LENGTH, rows: int = ROWS
) -> DataFrame:
    """Write ids and masks below `root`; the manifest: part, name, documents, tokens, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        coder = encoder(path)
        kind = pa.uint16() if coder.library.get_vocab_size() <= 1 << 16 else pa.uint32()
        store, folder = _store(root)
        name = uuid.uuid4().hex  # of this attempt alone
        writer = index = None
        documents = tokens = 0
        for names, texts in slices(batches):
            if writer is None and texts:
                store.create_dir(folder, recursive=True)
                sinks = [store.open_output_stream(f"{folder}/{name}.{x}.arrow") for x in ("ids", "docs")]
                writer = SequenceWriter(sinks[0], kind, length, rows)
                index = pa.ipc.new_file(sinks[1], DOCUMENTS)
            done = 0
            for group in chunks(texts):
                own = names[done : done + len(group)]
                coded = [np.append(x, np.uint32(end)) for x in coder.encode(group)]
                sizes = np.fromiter(map(len, coded), np.int64, len(coded))
                starts = tokens + np.cumsum(sizes) - sizes
                for ids in coded:
                    writer.add(ids)
                index.write_batch(pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array(starts), pa.array(sizes)], schema=DOCUMENTS
                ))
                done, documents, tokens = done + len(group), documents + len(own), tokens + int(sizes.sum())
        if writer is not None:
            writer.close()
            index.close()
            for sink in sinks:
                sink.close()
            yield TaskContext.get().partitionId(), name, documents, tokens

    order = [F.asc_nulls_first("doc_id"), F.asc("h")]
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange(shuffle_partitions(docs), *order)
        .sortWithinPartitions(*order)
    )
    files = map_batches(
        ordered.select("doc_id", "text"), run, "part int, name string, documents bigint, tokens bigint"
    )
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return written(files, "files").withColumn(  # one row per file
        "start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("bigint"))
    )


def read_token_files(manifest: DataFrame, root: str) -> DataFrame:
    """Every document from the files: doc_id, start (over all files), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, folder = _store(root)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                reader = SequenceReader(f"{root}/{name}.ids.arrow")
                with store.open_input_file(f"{folder}/{name}.docs.arrow") as source:
                    index = pa.ipc.open_file(source)
                    for i in range(index.num_record_batches):
                        part = index.get_batch(i)
                        for doc, first, size in zip(*(c.to_pylist() for c in part.columns)):
                            crc = 0
                            for ids in reader.ids(first, size):
                                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            yield doc, start + first, size, crc

    spread = manifest.select("name", "start").repartition(shuffle_partitions(manifest), "name")
    return map_batches(spread, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "tokens")
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, tokenizer_path("word_bpe_49k.json"), root), root)
