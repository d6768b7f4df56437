"""Knowledge base and dialogue formats derived from the given tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.functions.knowledge_text import escape_separators
from lorewell.functions.labels import triple_text
from lorewell.functions.text import STOP_WORDS, WORD, content_words, plural_lemma
from lorewell.operators.annotated import Annotation
from lorewell.operators.ordered import with_neighbour
from lorewell.operators.scratch import shuffle_partitions

# Relation names of the derived knowledge base, in index order.
RELATIONS = (
    "RelatedTo Synonym IsA DerivedFrom HasContext Antonym FormOf UsedFor AtLocation CapableOf "
    "PartOf Causes HasA HasProperty MannerOf SimilarTo Desires MadeOf ReceivesAction"
).split()



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _relation(start: Column, end: Column, shift: int = 0) -> Column:
    index = (F.length(start) * 7 + F.length(end) * 3 + shift) % len(RELATIONS)
    return F.element_at(F.array(*[F.lit(r) for r in RELATIONS]), index + 1)


def word_runs(documents: DataFrame) -> DataFrame:
    """Counts of two and three neighbouring words without stop words; `w3` is null for pairs."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    spread = documents.select("lang", "text").repartition(shuffle_partitions(documents))
    docs = spread.select("lang", words.alias("ws"))
    n_pairs = F.greatest(F.size("ws") - 1, F.lit(0))
    zipped = F.arrays_zip(
        F.slice("ws", 1, n_pairs).alias("w"),
        F.slice("ws", 2, n_pairs).alias("w2"),
        F.slice("ws", 3, n_pairs).alias("w3"),
    )
    triples = docs.select("lang", F.inline(zipped).alias("w", "w2", "w3")).filter(
        ~F.col("w").isin(STOP_WORDS) & ~F.col("w2").isin(STOP_WORDS)
    )
    # a run travels once, as one string (words have no spaces), to where all runs of its pair are
    longer = F.when(~F.col("w3").isin(STOP_WORDS), F.col("w3"))
    run = triples.select("lang", F.concat_ws(" ", "w", "w2", longer).alias("run"))
    pair = F.substring_index("run", " ", 2)
    spread = run.repartition(shuffle_partitions(documents), "lang", pair)
    third = F.get(F.split("run", " "), F.lit(2))
    nothing = F.lit(None).cast("string")
    thirds = F.when(third.isNull(), F.array(nothing)).otherwise(F.array(nothing, third))
    counted = (
        spread.select("lang", pair.alias("pair"), F.explode(thirds).alias("w3"))
        .groupBy("lang", "pair", "w3")
        .agg(F.count("*").alias("n"))
    )
    ws = F.split("pair", " ")
    return counted.select("lang", ws[0].alias("w"), ws[1].alias("w2"), "w3", "n")


def assertion_uri() -> Column:
    """The URI of an assertion from its relation and its two ends."""
    return F.concat(
        F.lit("/a/["), "relation", F.lit("/,"), "start_uri", F.lit("/,"), "end_uri", F.lit("/]")
    )


def _as_assertions(parts: DataFrame) -> DataFrame:
    """(lang, start, suffix, end, relation, n) -> the five raw columns."""
    rows = parts.select(
        F.concat(F.lit("/r/"), "relation").alias("relation"),
        F.concat(F.lit("/c/"), "lang", F.lit("/"), "start", "suffix").alias("start_uri"),
        F.concat(F.lit("/c/"), "lang", F.lit("/"), "end").alias("end_uri"),
        F.concat(
            F.lit('{"weight": '), (F.col("n") / F.lit(2.0)).cast("string"), F.lit("}")
        ).alias("extra"),
    )
    return rows.select(assertion_uri().alias("uri"), "relation", "start_uri", "end_uri", "extra")


def assertions(documents: DataFrame) -> DataFrame:
    """Raw assertions: word pairs, two-word starts, and second copies under another sense."""
    runs = word_runs(documents).filter(F.col("w3").isNull() | (F.col("n") >= 2))
    phrase = F.col("w3").isNotNull()
    start = F.when(phrase, F.concat_ws("_", "w", "w2")).otherwise(F.col("w"))
    end = F.coalesce("w3", "w2")
    sense = ~phrase & (F.length("w") % 3 == 0)
    named = runs.select(
        "lang", start.alias("start"), end.alias("end"), sense.alias("sense"), "n"
    )

    def copy(suffix: Column, shift: int) -> Column:
        relation = _relation(F.col("start"), F.col("end"), shift)
        return F.struct(suffix.alias("suffix"), relation.alias("relation"))

    plain = copy(F.when(F.col("sense"), F.lit("/n")).otherwise(F.lit("")), 0)
    clash = copy(F.lit("/v"), 1)
    copies = F.when(
        F.col("sense") & (F.length("end") % 4 == 0), F.array(plain, clash)
    ).otherwise(F.array(plain))
    return _as_assertions(named.select("lang", "start", "end", "n", F.inline(copies)))


# --- dialogue formats ------------------------------------------------------

CONVERSATIONS_PER_FILE = 64


def lemma_table(conversations: DataFrame) -> DataFrame:
    """(surface, lemma) for the plural-like words of the conversations."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    surface = conversations.select(words.alias("surface")).distinct()
    plural = surface.filter(F.col("surface").endswith("s") & (F.length("surface") > 4))
    return plural.withColumn("lemma", plural_lemma(F.col("surface")))


def compounds(annotation: Annotation, keys: tuple[str, ...]) -> Annotation:
    """The same with every word of a run but the last as a compound."""
    cut = F.col("is_stop") | F.col("is_punct")
    after = F.lead(cut).over(W.partitionBy(*keys, "sent_no").orderBy("pos"))
    dep = F.when(~cut & (after == F.lit(False)), F.lit("compound")).otherwise(F.lit(""))
    return Annotation(annotation.tokens.withColumn("dep", dep), annotation.chunks)


def word_vectors(conversations: DataFrame, edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(word, vec) for the content words of turns and triples: whole numbers from a row drawn by hash."""
    said = conversations.select("text").unionByName(
        edges.select(triple_text("start", "relation", "end").alias("text"))
    )
    words = said.select(F.explode(content_words(F.col("text"), STOP_WORDS)).alias("word")).distinct()
    draw = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint")
    rows = embeddings.select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("float")).alias("vec")
    )
    drawn = words.withColumn("vec_id", draw % embeddings.count())
    return drawn.join(rows, "vec_id").select("word", "vec")


def placed_turns(conversations: DataFrame, header: int = 0) -> DataFrame:
    """Turns with their file and dense line number, text on one line, and the texts around.

    64 conversations make a file; only their sizes are summed up per file.
    """
    file_no = F.floor(F.col("conv_id") / CONVERSATIONS_PER_FILE).cast("bigint")
    sizes = conversations.groupBy("conv_id").agg(
        F.count("*").alias("_n"), F.max("turn").alias("last_turn")
    )
    before = W.partitionBy("_f").orderBy("conv_id").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_f", file_no).select(
        "conv_id",
        "last_turn",
        F.concat(F.lit("f"), F.col("_f").cast("string")).alias("file"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    turns = conversations.withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    near = with_neighbour(turns, ["conv_id"], "turn", {"prev": "text"}, -1)
    near = with_neighbour(near, ["conv_id"], "turn", {"next": "text"}, 1)
    placed = near.join(starts, "conv_id")
    line_no = (F.col("_start") + F.col("turn") + 1 + header).cast("bigint")
    return placed.withColumn("line_no", line_no).drop("_start")


def convai_lines(conversations: DataFrame) -> DataFrame:
    number = (F.col("turn") + 1).cast("string")
    tail = F.concat(F.lit("\t"), "next", F.lit("\t\t"), "next", F.lit("|"), "role")
    said = F.concat(number, F.lit(" "), "text", tail)
    persona = F.concat(number, F.lit(" your persona: "), "text")
    line = F.when(F.col("role") == "system", persona).otherwise(said)
    return (
        placed_turns(conversations)
        .filter(F.col("next").isNotNull())
        .select("file", "line_no", line.alias("line"))
    )


def two_words(text: Column | str = "text") -> Column:
    """The first two words of a text: stand-in items for the readers of knowledge."""
    return F.slice(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), 1, 2)


def bst_lines(
    conversations: DataFrame, concepts: bool = False, broken: bool = False, faults: bool = False
) -> DataFrame:
    """`broken`: the closing line of some conversations has no labels; `faults`: or another fault."""
    closes = F.col("turn") + 1 == F.col("last_turn")

    def fault(number: int, given: bool) -> Column:
        return F.lit(given) & closes & (F.col("conv_id") % 7 == number)

    no_labels = fault(3, broken or faults)
    done = F.when(F.col("turn") + 1 == F.col("last_turn"), F.lit("\tepisode_done:True"))
    parts = [
        F.when(fault(4, faults), F.lit("note:")).otherwise(F.lit("text:")),
        F.coalesce("prev", F.lit("")),
        F.lit("\tfree_message:"),
        F.col("text"),
        F.when(no_labels, F.lit("")).otherwise(F.concat(F.lit("\tlabels:"), "next")),
        F.coalesce(done, F.lit("")),
    ]
    parts.append(F.when(fault(5, faults), F.lit("\teval_labels:x")).otherwise(F.lit("")))
    if concepts:
        cell = F.concat(F.lit("\tconcepts:"), F.array_join(two_words(), "|"))
        parts.append(F.when(fault(6, faults), F.lit("")).otherwise(cell))
    return (
        placed_turns(conversations)
        .filter(F.col("next").isNotNull())
        .select("file", "line_no", F.concat(*parts).alias("line"))
    )


def ed_lines(conversations: DataFrame, concepts: bool = False) -> DataFrame:
    placed = placed_turns(conversations, header=1)

    tag = F.when(
        (F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), F.lit("<POLITICAL>")
    ).otherwise(F.lit(""))
    cands = F.when(
        F.col("conv_id") % 2 == 0,
        F.concat(F.lit(","), escape_separators(F.col("text")), F.lit("|"), "role"),
    ).otherwise(F.lit(""))
    parts = [
        F.lit("hit:"),
        F.col("conv_id").cast("string"),
        F.lit(","),
        (F.col("turn") + 1).cast("string"),
        F.lit(","),
        F.col("role"),
        F.lit(","),
        escape_separators(F.substring("text", 1, 20)),
        F.lit(",0,"),
        escape_separators(F.col("text")),
        F.lit(",x,"),
        tag,
        cands,
    ]
    if concepts:
        parts += [F.lit(","), F.array_join(two_words(), "|")]
    rows = placed.select("file", "line_no", F.concat(*parts).alias("line"))
    names = "conv_id,utterance_idx,context,prompt,speaker_idx,utterance,selfeval,tags"
    header = placed.select("file").distinct().select(
        "file", F.lit(1).cast("bigint").alias("line_no"), F.lit(names).alias("line")
    )
    return header.unionByName(rows)


def _episodes(conversations: DataFrame, entry: Column) -> DataFrame:
    """Entries in order, one row per conversation."""
    part = F.lit(0).cast("bigint")
    listed = F.collect_list(F.struct("turn", entry.alias("e")))
    return (
        conversations.withColumn("part", part)
        .groupBy("conv_id", "part")
        .agg(F.transform(F.array_sort(listed), lambda x: x["e"]).alias("entries"))
    )


def wow_episodes(conversations: DataFrame, concepts: bool = False) -> DataFrame:
    wizard = F.col("role") == "assistant"
    fields = [
        F.when(wizard, F.lit("1_Wizard")).otherwise(F.lit("0_Apprentice")).alias("speaker"),
        F.col("text"),
    ]
    if concepts:
        fields.append(two_words().alias("concepts"))
    episodes = _episodes(conversations, F.struct(*fields))
    first = F.get("entries", F.lit(0))["text"]
    return episodes.select(
        "conv_id",
        "part",
        F.get(two_words(first), F.lit(0)).alias("chosen_topic"),
        F.col("entries").alias("dialog"),
    )


def bst_episodes(conversations: DataFrame) -> DataFrame:
    flat = conversations.withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    entry = F.struct(F.array("role", "text").alias("said"), two_words().alias("items"))
    episodes = _episodes(flat, entry)
    return episodes.select(
        "conv_id",
        "part",
        F.transform("entries", lambda e: e["said"]).alias("dialog"),
        F.transform("entries", lambda e: e["items"]).alias("concepts"),
    )


def array_files(rows: DataFrame, path: str) -> None:
    """Write rows as JSON files that hold one array each, one file per task."""

    def run(batches):
        names = ["value"]
        opened = False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lines = [("," if opened or i else "[") + x for i, x in enumerate(texts)]
            opened = opened or bool(lines)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(["]" if opened else "[]"], pa.string())], names=names)

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInArrow(run, "value string").write.text(path)
