"""Edge dump and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorewell.sources.dialogs import with_line_numbers

ASSERTION_SCHEMA = "uri string, relation string, start_uri string, end_uri string, extra string"
EDGE_SCHEMA = ASSERTION_SCHEMA + ", weight double"
COLLAPSED_SCHEMA = "start string, end string, relation string, weight double"


def read_assertions(
    spark: SparkSession,
    path: str | list[str],
    numbered: bool = False,
    folder_is_file: bool = False,
) -> DataFrame:
    """Tab-separated dump without a header; gzip is read as it is.

    `numbered` adds `file` and `line_no` for the last-row-wins rule; with `folder_is_file` the
    part files of a folder are numbered as one. The dump is scanned once; a gzip file is one split,
    but what is made of its staged rows is not.
    """
    rows = (
        spark.read.schema(ASSERTION_SCHEMA)
        .option("sep", "\t")
        .option("quote", "")
        .option("escape", "")
        .csv(path)
    )
    return with_line_numbers(rows, folder_is_file) if numbered else rows


def read_edges(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str = EDGE_SCHEMA
) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        # quotes inside a field are doubled, as the metadata column is JSON
        return reader.option("header", True).option("escape", '"').csv(path)
    return reader.format(fmt).load(path)


def write_edges(edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = edges.write
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
