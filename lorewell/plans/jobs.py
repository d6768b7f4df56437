"""The whole jobs, from files to files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.text import STOP_WORDS
from lorewell.operators import edges as E
from lorewell.operators import examples as X
from lorewell.operators.annotated import Annotator
from lorewell.operators.augment import augment
from lorewell.operators.dense import DenseIndex
from lorewell.operators.knowledge import EdgeIndex, build_index
from lorewell.operators.scratch import shuffle_partitions, written
from lorewell.operators.terms import Lemma
from lorewell.sources import assertions as SA
from lorewell.sources import dialogs as SD

CHECKED = "file string, line_no bigint, line string, error string"


def build_knowledge_base(
    spark: SparkSession,
    dump: str | list[str],
    out: str,
    lang: str = "en",
    at_least: float = 1.0,
    n_relations: int = 16,
    exclude: Sequence[str] = E.EXCLUDED_RELATIONS,
) -> None:
    """Edge dump -> `filtered` (all relations), `restricted` (top ones) and `graph` below `out`.

    Also `relations`, the kept ones with their special tokens, and `no_weight`,
    rows of the language without a usable weight. The dump is scanned once; the rows of the
    language are spread and written with their numbers.
    """
    raw = SA.read_assertions(spark, dump, numbered=True)
    rows = E.with_weight(E.english_edges(raw, lang))
    weighted = written(rows.repartition(shuffle_partitions(rows)), "weighted")
    E.without_weight(weighted).write.parquet(f"{out}/no_weight")
    labelled = E.with_labels(E.min_weight(weighted, at_least), lang)
    SA.write_edges(E.drop_same_stem(labelled), f"{out}/filtered")
    filtered = spark.read.parquet(f"{out}/filtered")
    relations = E.top_relations(filtered, n_relations, exclude)
    E.relation_special_tokens(relations).write.parquet(f"{out}/relations")
    kept = E.restrict_relations(filtered, spark.read.parquet(f"{out}/relations"))
    SA.write_edges(kept, f"{out}/restricted")
    restricted = spark.read.parquet(f"{out}/restricted")
    graph = E.collapse_edges(restricted, F.struct("file", "line_no"))
    SA.write_edges(graph, f"{out}/graph")


def load_index(
    spark: SparkSession,
    out: str,
    k: int = 3,
    all_relations: bool = False,
    stop_words: Sequence[str] = STOP_WORDS,
) -> EdgeIndex:
    """Index over the restricted graph, or over all filtered relations."""
    if all_relations:
        edges = spark.read.parquet(f"{out}/filtered")
        return build_index(E.collapse_edges(edges, F.struct("file", "line_no")), k, stop_words=stop_words)
    edges = SA.read_edges(spark, f"{out}/graph", schema=SA.COLLAPSED_SCHEMA)
    return build_index(edges, k, stop_words=stop_words)


def augment_dataset(
    spark: SparkSession,
    dataset: str,
    paths: str | list[str],
    index: EdgeIndex | DenseIndex,
    out: str,
    split: str = "train",
    variant: str | None = None,
    lemma: Lemma | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
    annotator: Annotator | None = None,
) -> None:
    """Dialogue files of one dataset and split -> the same with knowledge.

    Lines go to `out/checked` as a table with file, line number and error, and
    from there to `out/lines` as plain text in their order; nested episodes go
    to `out/episodes`. All are laid out by dataset, split and variant (`variant_name` unless
    given); a rerun replaces its own three only. `out/files` of a run has one output for each input
    file, with a manifest.
    """
    variant = variant or SD.variant_name(dataset, True)
    place = (dataset, split, variant)
    # a run has its own folder, earlier ones stay
    files = f"{out}/files/dataset={dataset}/split={split}/variant={variant}/run={uuid.uuid4().hex}"
    if dataset == "wow":
        episodes = SD.read_dialog_json(spark, paths)
        found = augment("wow", episodes, index, lemma, stop_words, annotator)
        SD.write_layout(found, f"{out}/episodes", *place, fmt="json")
        fields = F.to_json(F.struct(*[c for c in found.columns if c not in ("file", "episode_id")]))
        lines = found.select("file", F.col("episode_id").alias("line_no"), fields.alias("line"))
        SD.write_line_files(lines, files)
        return
    found = augment(dataset, SD.read_dialog_lines(spark, paths), index, lemma, stop_words, annotator)
    SD.write_layout(found, f"{out}/checked", *place)
    checked = SD.read_table(spark, f"{out}/checked", CHECKED, *place)
    laid_out = checked.withColumns(dict(zip(SD.LAYOUT, map(F.lit, place))))
    SD.write_dialog_lines(laid_out, f"{out}/lines", partition_by=SD.LAYOUT)
    SD.write_line_files(checked, files)


def write_validated(lines: DataFrame, out: str, strict: bool = False) -> dict[str, int]:
    """Check `key:value` lines and write them in one pass: good ones and those in quarantine.

    The counts come from the same pass: `lines`, `bad`, and how often each rule was broken. With
    `strict` any bad line is an error, raised when the pass is over, so that the message and
    the quarantine are whole.
    """
    counts = Observation()
    checked = X.validate_examples(lines).select("file", "line_no", "line", "errors")
    place = F.when(F.size("errors") == 0, "good").otherwise("quarantine")
    watched = checked.observe(counts, *X.error_counts()).withColumn("place", place)
    watched.write.partitionBy("place").parquet(out)
    found = counts.get
    if strict and found["bad"]:
        raise ValueError(f"{found['bad']} of {found['lines']} lines are bad: {found}; see {out}/place=quarantine")
    return found


def read_validated(spark: SparkSession, out: str, place: str = "good") -> DataFrame:
    """The good lines, or those in quarantine with their errors; the other folder is not read."""
    schema = "file string, line_no bigint, line string, errors array<string>, place string"
    return spark.read.schema(schema).parquet(out).filter(F.col("place") == place).drop("place")


def read_examples(
    spark: SparkSession,
    dataset: str,
    root: str,
    split: str = "train",
    variant: str | None = None,
    candidates: bool = True,
    **options,
) -> DataFrame:
    """Augmented dataset -> training examples of the variant that `variant_name` gives, or a named one."""
    place = (dataset, split, variant or SD.variant_name(dataset, True, candidates))
    if dataset == "wow":
        schema = SD.WOW_SCHEMA.replace("concepts: array<string>", "concepts: string")
        schema += ", file string, episode_id bigint"
        return X.wow_examples(SD.read_table(spark, f"{root}/episodes", schema, *place, fmt="json"), **options)
    lines = SD.read_table(spark, f"{root}/checked", CHECKED, *place).drop("error")
    readers = {
        "bst": X.bst_examples,
        "convai": X.convai_examples,
        "empathy": lambda ls, **o: X.ed_examples(X.pair_turns(ls), **o),
    }
    return readers[dataset](lines, **options)
