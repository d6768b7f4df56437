"""The operators as stages of the corpus pipeline: documents in, documents out.

Nulls, by stage: a null text has no letter, so the first stage drops it; a later stage given
one takes it as empty (fingerprint zero, nothing to mask, size 0, one end token). A null doc_id,
lang or source is a value like any other: it is never a reason to drop a row. Empty texts are
handled as null ones. Texts are read whole, whatever their length. Repeated rows are separate
documents up to near-dedup, which keeps one of them. Ties: of equal doc_ids in a group of
copies the row that comes first in the written table stays; equal documents of one source
are mixed by their row number. An empty table gives an empty table with the same columns.
Columns beside those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import language, mixing, packing, secrets, simhash
from lorewell.llm.shared import tokenizer_path, written

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def numbered(docs: DataFrame) -> DataFrame:
    """The documents written once with a number of their own, so equal rows stay apart."""
    return written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told; a missing label is filled in."""
    references = language.learn_references(docs)
    rows = docs.select(*DOCUMENT)
    return language.keep_known(rows, references)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id."""
    rows = numbered(docs.select(*DOCUMENT))
    prints = written(simhash.fingerprints(rows, also=("row",)), "prints")
    classed = prints.join(simhash.near_classes(prints), "fp", "left")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    kept = classed.groupBy(F.coalesce("class", "fp").alias("class")).agg(first["row"].alias("row"))
    return rows.join(kept, "row", "left_semi").select(*DOCUMENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    masked = secrets.redact_secrets(docs.select(*DOCUMENT))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times."""
    rows = numbered(docs.select(*DOCUMENT))
    mixed = mixing.mix_sources(mixing.document_sizes(rows, "row")).select("row", "copies")
    taken = rows.join(mixed.filter("copies > 0"), "row")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.select(*DOCUMENT, copies.alias("copy")).select(*DOCUMENT)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))
