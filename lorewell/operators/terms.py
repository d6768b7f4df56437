"""Messages -> sentences, tokens and lookup terms.

Two ways lead to the same terms. `message_sentences` and `sentence_terms` keep
all work inside the message's row. `tokens`, `first_mention`, `lemmas` and
`group_terms` work on a token table, which is what an outside annotator would
deliver; they shuffle, but can look up a lemma table and can count first
mentions over more than one message.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T

Lemma = Callable[[Column], Column]


def _coded_messages(
    messages: DataFrame, keys: Sequence[str], text: str, stop_words: Sequence[str]
) -> DataFrame:
    sents = messages.select(*keys, T.sentences(text).alias("sents"))
    return sents.withColumn("coded", T.coded_tokens(F.col("sents"), stop_words))


def message_sentences(
    messages: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    stop_words: Sequence[str] = T.STOP_WORDS,
    dedupe: bool = True,
) -> DataFrame:
    """One row per sentence: its content words, and its runs of words.

    With `dedupe` a run holds only words that the message has not had before.
    Repeats are found by sorting (word, position), so a long message costs
    n log n and never leaves its row.
    """
    coded = _coded_messages(messages, keys, text, stop_words)
    coded = coded.withColumn(
        "sorted",
        F.array_sort(F.transform("coded", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
    )

    def masked(x: Column, i: Column) -> Column:
        repeat = (i > 0) & (F.get("sorted", i - 1)["w"] == x["w"])
        keep = x["w"].isin(T.RUN_END, T.SENTENCE_END) | ~repeat
        return F.struct(x["i"], F.when(keep, x["w"]).otherwise(F.lit("")).alias("w"))

    fresh = F.transform(F.array_sort(F.transform("sorted", masked)), lambda y: y["w"])
    as_text = F.array_join("coded", " ")
    coded = coded.select(
        *keys,
        "sents",
        F.split(as_text, T.SENTENCE_END, -1).alias("all_words"),
        F.split(F.array_join(fresh, " ") if dedupe else as_text, T.SENTENCE_END, -1).alias("runs"),
    )
    rows = coded.select(*keys, F.posexplode(F.arrays_zip("sents", "all_words", "runs")).alias("_no", "_s"))
    # split() leaves one empty piece behind the last sentence end
    return rows.filter(F.col("_s.sents").isNotNull()).select(
        *keys,
        F.col("_no").cast("bigint").alias("sent_no"),
        F.col("_s.sents").alias("sentence"),
        T.split_words(F.col("_s.all_words")).alias("words"),
        T.split_runs(F.col("_s.runs")).alias("runs"),
    )


def sentence_counts(sents: DataFrame) -> DataFrame:
    """Word counts of each sentence (`tf`) and their squared norm (`norm`)."""
    cols = [c for c in sents.columns if c != "words"]
    ordered = sents.select(*cols, F.array_sort("words").alias("ws"))
    # positions where a new word begins in the sorted list
    starts = F.filter(
        F.transform("ws", lambda w, i: i),
        lambda i: (i == 0) | (F.get("ws", i - 1) != F.get("ws", i)),
    )
    ordered = ordered.withColumn("at", starts)
    counts = F.transform("at", lambda a, j: F.coalesce(F.get("at", j + 1), F.size("ws")) - a)
    ordered = ordered.select(
        *cols, F.transform("at", lambda a: F.get("ws", a)).alias("feats"), counts.alias("counts")
    )
    norm = F.aggregate(
        "counts",
        F.lit(0).cast("bigint"),
        lambda acc, n: acc + n.cast("bigint") * n.cast("bigint"),
    )
    return ordered.select(
        *cols, F.map_from_arrays("feats", "counts").alias("tf"), norm.alias("norm")
    )


def sentence_terms(
    sents: DataFrame,
    keys: Sequence[str],
    lemma: Lemma | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Bag of lookup terms per run: (keys, sent_no, group_no, term) and carried columns."""

    def terms(run: Column, i: Column) -> Column:
        words = F.transform(run, lemma) if lemma else run
        return F.transform(
            T.run_terms(words),
            lambda t: F.struct(i.cast("bigint").alias("group_no"), t.alias("term")),
        )

    bag = F.flatten(F.transform("runs", terms))
    return sents.select(*keys, "sent_no", *carry, F.inline(bag))


def sentences(messages: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    return messages.select(
        *keys, F.posexplode(T.sentences(text)).alias("sent_no", "sentence")
    ).withColumn("sent_no", F.col("sent_no").cast("bigint"))


def tokens(
    messages: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    stop_words: Sequence[str] = T.STOP_WORDS,
) -> DataFrame:
    """Token table of all kept words: (keys, sent_no, group_no, pos, surface).

    Groups are numbered before repeats are dropped; only identity counts.
    """
    return run_tokens(message_sentences(messages, keys, text, stop_words, dedupe=False), keys)


def run_tokens(sents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The token table of cut sentences with their `runs`."""

    def words(run: Column, i: Column) -> Column:
        return F.transform(
            run,
            lambda w, p: F.struct(
                i.cast("bigint").alias("group_no"),
                p.cast("bigint").alias("pos"),
                w.alias("surface"),
            ),
        )

    return sents.select(*keys, "sent_no", F.inline(F.flatten(F.transform("runs", words))))


def first_mention(
    token_table: DataFrame, scope: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Keep the first occurrence of each surface form within a scope.

    An aggregate keyed by (scope, surface): counts combine before the shuffle
    and a huge scope is spread over its words.
    """
    others = [c for c in token_table.columns if c not in (*scope, *order, "surface")]
    first = F.min(F.struct(*order, *others)).alias("t")
    return token_table.groupBy(*scope, "surface").agg(first).select(
        *scope, *[f"t.{c}" for c in (*order, *others)], "surface"
    )


def lemmas(token_table: DataFrame, lemma_table: DataFrame) -> DataFrame:
    """Add `term`: the lemma where the table has one, else the surface form."""
    forms = lemma_table.select("surface", "lemma").dropDuplicates(["surface"])
    joined = token_table.join(forms, "surface", "left")
    return joined.withColumn("term", F.coalesce("lemma", F.lower("surface"))).drop("lemma")


def group_terms(term_table: DataFrame, group: Sequence[str]) -> DataFrame:
    """Bag of lookup terms per token group: its phrase if it has several tokens, and each token.

    A group is part of one sentence, so its list is bounded by the message.
    """
    lists = term_table.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("ts")
    )
    words = F.transform("ts", lambda t: t["term"])
    return lists.select(*group, words.alias("ws")).select(
        *group, F.explode(T.run_terms(F.col("ws"))).alias("term")
    )
