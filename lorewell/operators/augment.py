"""Adding knowledge to the four dialogue formats and to live turns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions import knowledge_text as K
from lorewell.functions import lines as L
from lorewell.functions.text import STOP_WORDS
from lorewell.operators.annotated import Annotator
from lorewell.operators.dense import DenseIndex
from lorewell.operators.knowledge import EdgeIndex, extract_knowledge, knowledge_arrays
from lorewell.operators.knowledge import message_knowledge
from lorewell.operators.terms import Lemma

LINE_KEYS = ("file", "line_no")
Index = EdgeIndex | DenseIndex


def _lines_with_knowledge(
    queries: DataFrame,
    index: Index,
    lemma: Lemma | None,
    stop_words: Sequence[str],
    annotator: Annotator | None,
) -> DataFrame:
    """`query` null means: not a message. Adds the rendered `knowledge`."""
    ranked = message_knowledge(
        queries.filter(F.col("query").isNotNull()),
        index,
        LINE_KEYS,
        "query",
        stop_words,
        lemma,
        annotator=annotator,
    )
    cells = knowledge_arrays(ranked, LINE_KEYS).select(
        *LINE_KEYS, K.render_enveloped("triples").alias("knowledge")
    )
    joined = queries.join(cells, list(LINE_KEYS), "left")
    return joined.withColumn("knowledge", F.coalesce("knowledge", F.lit("")))


def augment_convai(
    lines: DataFrame,
    index: Index,
    lemma: Lemma | None = None,
    keep_leading_digits: bool = False,
    stop_words: Sequence[str] = STOP_WORDS,
    annotator: Annotator | None = None,
) -> DataFrame:
    """Numbered lines: knowledge goes before the first tab; persona lines stay as they are."""
    persona = F.contains("line", F.lit("persona:"))
    query = L.numbered_query("line", keep_leading_digits)
    found = _lines_with_knowledge(
        lines.withColumn("query", F.when(~persona, query)), index, lemma, stop_words, annotator
    )
    full = F.concat(L.numbered_head("line"), "knowledge", L.numbered_tail("line"))
    no_tab = ~persona & ~F.contains("line", F.lit("\t"))
    return found.select(
        *LINE_KEYS,
        F.when(persona, F.col("line")).otherwise(full).alias("line"),
        F.when(no_tab, F.lit("no tab in line")).alias("error"),
    )


def augment_bst(
    lines: DataFrame,
    index: Index,
    lemma: Lemma | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
    annotator: Annotator | None = None,
) -> DataFrame:
    """`key:value` lines: a `concepts` field is added, found with the first `free_message`."""
    mark = "free_message:"
    fields = F.filter(F.split("line", "\t", -1), lambda f: f.startswith(mark))
    query = F.replace(F.get(fields, F.lit(0)), F.lit(mark), F.lit(""))
    found = _lines_with_knowledge(
        lines.withColumn("query", query), index, lemma, stop_words, annotator
    )
    return found.select(
        *LINE_KEYS,
        F.concat(L.strip_space("line"), F.lit("\tconcepts:"), "knowledge").alias("line"),
        F.when(F.col("query").isNull(), F.lit("no free_message")).alias("error"),
    )


def augment_ed(
    lines: DataFrame,
    index: Index,
    lemma: Lemma | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
    annotator: Annotator | None = None,
) -> DataFrame:
    """Comma-split lines: knowledge becomes the last field, the header gets its name."""
    stripped = L.strip_space("line")
    parts = F.split(stripped, ",", -1)
    header = F.get(parts, F.lit(0)) == "conv_id"
    text = K.unescape_commas(F.get(parts, F.lit(5)))
    found = _lines_with_knowledge(
        lines.withColumn("query", F.when(~header, text)), index, lemma, stop_words, annotator
    )
    cell = F.when(header, F.lit("concepts")).otherwise(F.col("knowledge"))
    short = ~header & F.get(parts, F.lit(5)).isNull()
    return found.select(
        *LINE_KEYS,
        F.concat(stripped, F.lit(","), cell).alias("line"),
        F.when(short, F.lit("fewer than six fields")).alias("error"),
    )


def augment_wow(
    episodes: DataFrame,
    index: Index,
    lemma: Lemma | None = None,
    keys: tuple[str, ...] = ("file", "episode_id"),
    stop_words: Sequence[str] = STOP_WORDS,
    annotator: Annotator | None = None,
) -> DataFrame:
    """Nested episodes: every entry of `dialog` gets its `concepts`.

    The list is rebuilt from the entry's own row, so it is as long as it was.
    """
    entries = episodes.select(*keys, F.posexplode("dialog").alias("pos", "entry"))
    turns = entries.select(*keys, "pos", F.col("entry.text").alias("text"))
    ranked = message_knowledge(
        turns, index, [*keys, "pos"], "text", stop_words, lemma, annotator=annotator
    )
    cells = (
        knowledge_arrays(ranked, [*keys, "pos"])
        .withColumn("cell", K.render_enveloped("triples", escape=False))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "cell"))).alias("cells"))
    )
    joined = episodes.join(cells, list(keys), "left")
    kept = [
        f for f in episodes.schema["dialog"].dataType.elementType.fieldNames() if f != "concepts"
    ]
    dialog = F.transform(
        "dialog",
        lambda e, i: F.struct(
            *[e[f].alias(f) for f in kept],
            F.coalesce(F.element_at("cells", i), F.lit("")).alias("concepts"),
        ),
    )
    return joined.withColumn("dialog", dialog).drop("cells")


AUGMENTERS: dict[str, Callable[..., DataFrame]] = {
    "bst": augment_bst,
    "convai": augment_convai,
    "wow": augment_wow,
    "empathy": augment_ed,
}


def augment(
    dataset: str,
    data: DataFrame,
    index: Index,
    lemma: Lemma | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
    annotator: Annotator | None = None,
) -> DataFrame:
    """The augmenter of a dataset by name; the index should have the same stop words."""
    return AUGMENTERS[dataset](data, index, lemma=lemma, stop_words=stop_words, annotator=annotator)


def augment_turns(
    turns: DataFrame,
    index: Index,
    keys: tuple[str, ...] = ("conv_id", "turn"),
    text: str = "text",
    lemma: Lemma | None = None,
    include_concepts: bool = True,
    stop_words: Sequence[str] = STOP_WORDS,
    annotator: Annotator | None = None,
) -> DataFrame:
    """Live form: the sentences of all triples in one envelope behind the utterance."""
    if not include_concepts:
        return turns
    found = extract_knowledge(turns, index, keys, text, stop_words, lemma, annotator=annotator)
    body = K.render_list("triples", ". ")
    full = F.concat(text, F.lit("\n"), K.envelope(body))
    return found.withColumn(text, full).drop("triples")
