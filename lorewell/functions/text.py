"""Sentences, words and word runs of a message, as array expressions.

All of it stays inside the message's own row: nothing is shuffled until terms
meet the edge table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A published English stop list, without contractions.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this
that these those am is are was were be been being have has had having do does did doing would
should could ought a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very
""".split()

SENTENCE = r"[^.!?\n]+[.!?]*"
WORD = r"[\p{L}\p{M}\p{N}]+"
# Apostrophes and hyphens part two words without ending the run they are in.
WORD_OR_MARK = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s'’-]"

RUN_END = "\n"
SENTENCE_END = "\f"


def sentences(text: Column | str) -> Column:
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.btrim(s, F.lit(" \t\r"))), lambda s: s != "")


def is_cut(token: Column, stop_words: Sequence[str]) -> Column:
    """True for stop words and punctuation: they end a run."""
    return token.isin(list(stop_words)) | ~token.rlike("^" + WORD)


def coded_tokens(sents: Column, stop_words: Sequence[str]) -> Column:
    """Lower-case words of all sentences in order, cuts replaced by end marks."""
    flat = F.flatten(
        F.transform(
            sents,
            lambda s: F.concat(
                F.regexp_extract_all(F.lower(s), F.lit(WORD_OR_MARK), F.lit(0)),
                F.array(F.lit(SENTENCE_END)),
            ),
        )
    )
    return F.transform(
        flat,
        lambda w: F.when(w == SENTENCE_END, w)
        .when(is_cut(w, stop_words), F.lit(RUN_END))
        .otherwise(w),
    )


def content_words(text: Column, stop_words: Sequence[str]) -> Column:
    """Lower-case non-stop words, with repeats."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\n ]+", -1), lambda w: w != "")


def split_runs(text: Column) -> Column:
    """array<array<string>>: the words of every run that still has some."""
    runs = F.transform(F.split(text, RUN_END, -1), split_words)
    return F.filter(runs, lambda r: F.size(r) > 0)


def run_terms(words: Column) -> Column:
    """Bag of lookup terms of a run: the phrase if there are several words, then each."""
    return F.when(
        F.size(words) > 1, F.concat(F.array(F.array_join(words, " ")), words)
    ).otherwise(words)


def plural_lemma(word: Column) -> Column:
    """Small rule lemma: drop a final `s` of words longer than four letters."""
    return F.when(
        word.endswith("s") & (F.length(word) > 4), F.substring(word, F.lit(1), F.length(word) - 1)
    ).otherwise(word)
