"""Terms meet edges: candidates, scores, the best k per group, knowledge per message."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.functions import vectors as V
from lorewell.functions.labels import triple_text
from lorewell.operators.annotated import (
    Annotation,
    Annotator,
    annotated_counts,
    annotated_sentences,
    annotated_terms,
)
from lorewell.operators.dense import DenseIndex, dense_candidates
from lorewell.operators.meeting import best_of_mentions
from lorewell.operators.scratch import shuffle_partitions, written
from lorewell.operators.sizes import broadcast_if_small, is_small
from lorewell.operators.terms import (
    Lemma,
    first_mention,
    group_terms,
    message_sentences,
    run_tokens,
    sentence_counts,
    sentence_terms,
)

TRIPLE = ("start", "relation", "end")
LONG_WORDS = 1000


# Parts of a spread lookup for each partition of a shuffle.
PARTS = 4
# A start with more than a part's share of the candidates, divided by this, is spread.
FINER = 16


def spread_starts(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """(hot, pieces, cut_edges) for starts with a large share of all candidates.

    The number of candidates of a start is that of its mentions times that of its edges. Of
    the two the longer list is cut into pieces, the other one goes to each of them. Both
    tables are counted here, so they should have been written.
    """
    mentions = terms.groupBy(F.col("term").alias("hot")).agg(F.count("*").alias("m"))
    degrees = edges.groupBy(F.col("start").alias("hot")).agg(F.count("*").alias("d"))
    met = mentions.join(degrees, "hot").withColumn("n", F.col("m").cast("double") * F.col("d"))
    met = written(met, "met")
    total = met.agg(F.sum("n")).first()[0] or 1.0
    share = total / (FINER * PARTS * shuffle_partitions(terms))
    pieces = F.least(F.ceil(F.col("n") / F.lit(share)), F.greatest("m", "d")).cast("int")
    hot = met.select("hot", pieces.alias("pieces"), (F.col("d") > F.col("m")).alias("cut_edges"))
    return hot.filter("pieces > 1")


def candidate_triples(
    terms: DataFrame, edges: DataFrame, spread: DataFrame | None = None
) -> DataFrame:
    """Every out-edge of every term; a term without edges gives nothing.

    An equi-join: Spark broadcasts the edges if they are under the session's
    threshold, else sorts and merges, splitting terms that are too frequent.
    Spark sees only the bytes that come in, though, not the candidates that come of them;
    with `spread_starts` the parts of the join have about as many candidates each.
    """
    if spread is None:
        return terms.join(edges, terms["term"] == edges["start"], "inner")
    few = F.broadcast(spread)
    parts = PARTS * shuffle_partitions(terms)

    def dealt(side: DataFrame, key: str, piece: str, is_cut: Column) -> DataFrame:
        pieces = F.coalesce("pieces", F.lit(1))
        one = F.array(F.pmod(F.col("_nth"), pieces).cast("int"))
        every = F.sequence(F.lit(0), pieces - 1)
        numbered = side.filter(F.col(key).isNotNull()).withColumn("_nth", F.monotonically_increasing_id())
        rows = numbered.join(few, F.col(key) == F.col("hot"), "left")
        at = F.explode(F.when(is_cut, one).otherwise(every)).alias(piece)
        return rows.select(*[F.col(c) for c in side.columns], at).repartition(parts, key, piece)

    left = dealt(terms, "term", "_piece", F.coalesce(~F.col("cut_edges"), F.lit(True)))
    right = dealt(edges, "start", "_part", F.coalesce("cut_edges", F.lit(True)))
    same = (F.col("term") == F.col("start")) & (F.col("_piece") == F.col("_part"))
    return left.join(right.hint("merge"), same, "inner").drop("_piece", "_part")


def triple_vectors(edges: DataFrame, stop_words: Sequence[str] = T.STOP_WORDS) -> DataFrame:
    """Add the content words of the triple's sentence form and their squared norm."""
    words = T.content_words(triple_text("start", "relation", "end"), stop_words)
    with_words = edges.withColumn("triple_words", words)
    return with_words.withColumn("triple_norm", V.squared_count_norm(F.col("triple_words")))


def sparse_scores(candidates: DataFrame) -> DataFrame:
    """Cosine of word counts; needs `tf`, `norm`, `triple_words` and `triple_norm`."""
    dot = V.term_dot(F.col("tf"), F.col("triple_words"))
    score = V.cosine_from_counts(dot, F.col("norm"), F.col("triple_norm"))
    return candidates.withColumn("score", score).drop("tf", "norm", "triple_words", "triple_norm")


def dense_scores(candidates: DataFrame, sentence_vec: str, triple_vec: str) -> DataFrame:
    """Cosine of two vector columns that the caller supplies."""
    score = V.dense_cosine(F.col(sentence_vec), F.col(triple_vec))
    return candidates.withColumn("score", score).drop(sentence_vec, triple_vec)


def top_triples(
    scored: DataFrame,
    group: Sequence[str],
    k: int = 3,
    bag: bool = True,
    order: Sequence[str] = TRIPLE,
) -> DataFrame:
    """The k best rows of each group, ties broken by the triple.

    Spark cuts each task's share of a group to k rows before the shuffle. With
    `bag` repeats of a triple take up places, as they come; otherwise they are
    merged first.
    """
    if not bag:
        scored = scored.groupBy(*group, *order).agg(F.max("score").alias("score"))
    best = W.partitionBy(*group).orderBy(F.desc("score"), *order)
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("bigint"))
    return ranked.filter(F.col("rank") <= k)


def distinct_triples(ranked: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per triple and scope: its first occurrence by sentence, group and rank."""
    place = ["sent_no", "group_no", "rank"]
    first = F.min(F.struct(*place, "score")).alias("p")
    return ranked.groupBy(*scope, *TRIPLE).agg(first).select(
        *scope, *[f"p.{c}" for c in place], *TRIPLE, "p.score"
    )


def knowledge_arrays(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per message: `triples`, distinct, in order of first occurrence.

    A message keeps at most k triples per group, so the list is bounded by it.
    """
    rows = F.collect_list(F.struct("sent_no", "group_no", "rank", *TRIPLE))
    triples = F.transform(
        F.array_sort("rows"), lambda r: F.struct(*[r[c].alias(c) for c in TRIPLE])
    )
    return ranked.groupBy(*keys).agg(rows.alias("rows")).select(
        *keys, F.array_distinct(triples).alias("triples")
    )


@dataclass(frozen=True)
class EdgeIndex:
    """Edges prepared for the sparse score.

    `edges` is looked up by (start, word). Rows with an empty word answer a
    mention of their start. A start with more edges than the limit is a hub: its
    empty-word rows are only those that can win without sharing a word of their
    end with the sentence, and all its edges are listed under each word of their
    end. `vectors` holds every edge once.
    """

    edges: DataFrame
    hubs: DataFrame | None
    vectors: DataFrame
    k: int


def index_edges(
    edges: DataFrame,
    k: int = 3,
    degree_limit: int | None = 64,
    stop_words: Sequence[str] = T.STOP_WORDS,
) -> EdgeIndex:
    """Split the out-edges of hub starts so that one mention never meets all of them.

    The score is the sum of shared words over the two norms. Take an edge whose
    end shares no word with the sentence:

    * its relation shares none either: every edge of the start with a smaller
      norm scores at least as much, so it needs to be among the k smallest by
      (norm, relation, end), or by (relation, end) if all scores are zero;
    * its relation does: the same holds within (start, relation).

    So the k first of these three orders, and the edges met by a word of their
    end, hold every possible winner. Edges must be unique by (start, end).
    """
    vectors = edges
    if "triple_words" not in edges.columns:
        vectors = triple_vectors(edges, stop_words)
    nothing = F.array().cast("array<string>")
    plain = vectors.withColumns({"word": F.lit(""), "end_words": nothing})
    if degree_limit is None:
        return EdgeIndex(plain, None, vectors, k)
    hubs = written(
        vectors.groupBy("start")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > degree_limit)
        .select("start"),
        "hubs",
    )
    # hubs are few: while they can be broadcast the edges stay where they are
    few = broadcast_if_small(hubs)
    light = plain.join(few, "start", "left_anti")
    end_words = F.array_distinct(T.content_words(F.col("end"), stop_words))
    heavy = plain.join(few, "start", "left_semi").withColumn("end_words", end_words)

    def first_k(by: Sequence[str], order: Sequence[str]) -> DataFrame:
        place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        return heavy.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")

    winners = (
        first_k(["start"], ["triple_norm", "relation", "end"])
        .unionByName(first_k(["start"], ["relation", "end"]))
        .unionByName(first_k(["start", "relation"], ["triple_norm", "end"]))
        .dropDuplicates(["start", "end"])
    )
    listed = heavy.withColumn("word", F.explode("end_words"))
    return EdgeIndex(light.unionByName(winners).unionByName(listed), hubs, vectors, k)


def build_index(
    edges: DataFrame,
    k: int = 3,
    degree_limit: int | None = 64,
    stop_words: Sequence[str] = T.STOP_WORDS,
) -> EdgeIndex:
    """`index_edges` with the triple vectors and the result written once."""
    vectors = written(triple_vectors(edges, stop_words), "edges")
    index = index_edges(vectors, k, degree_limit, stop_words)
    if index.hubs is None:
        return index
    return EdgeIndex(written(index.edges, "edge-index"), index.hubs, vectors, k)


def indexed_candidates(terms: DataFrame, index: EdgeIndex) -> DataFrame:
    """Candidates that can reach the first k places; terms carry `tf` and `norm`."""
    if index.hubs is None:
        probes = terms.withColumn("probe", F.lit(""))
    else:
        hubs = broadcast_if_small(index.hubs.select(F.col("start").alias("hub")))
        words = F.concat(F.array(F.lit("")), F.map_keys("tf"))
        flagged = terms.join(hubs, terms["term"] == hubs["hub"], "left")
        asked = F.when(F.col("hub").isNotNull(), words).otherwise(F.slice(words, 1, 1))
        probes = flagged.withColumn("probe", F.explode(asked)).drop("hub")
    edges = broadcast_if_small(index.edges)
    met = probes.join(
        edges, (probes["term"] == edges["start"]) & (probes["probe"] == edges["word"]), "inner"
    )
    # an edge counts once: at the first word of its end that the sentence has, else as empty
    first = F.get(F.filter("end_words", lambda w: F.map_contains_key("tf", w)), F.lit(0))
    return met.filter(F.col("word") == F.coalesce(first, F.lit(""))).drop(
        "term", "probe", "word", "end_words"
    )


def is_large(index: EdgeIndex) -> bool:
    """Are there too many edges to broadcast, so that terms must be shuffled to them?"""
    return index.hubs is not None and not is_small(index.edges)


def staged_counts(counts: DataFrame, index: EdgeIndex) -> DataFrame:
    """Sentences for `short_scores`: for a large index written once, as they are read twice."""
    return written(counts, "counts") if is_large(index) else counts


def short_scores(terms: DataFrame, index: EdgeIndex, sentence: Sequence[str]) -> DataFrame:
    """Scored candidates that can reach the first k places of a group; terms carry `tf` and `norm`."""
    if is_large(index):
        return best_of_mentions(terms, index.edges, [*sentence, "group_no"], index.k)
    return sparse_scores(indexed_candidates(terms, index)).select(*sentence, "group_no", *TRIPLE, "score")


def by_message(scored: DataFrame, index: EdgeIndex, keys: Sequence[str]) -> DataFrame:
    """What a large index gives goes back to its message: it is ranked and collected there without more shuffles."""
    return scored.repartition(shuffle_partitions(scored), *keys) if is_large(index) else scored


def long_scores(
    terms: DataFrame, counts: DataFrame, index: EdgeIndex, sentence: Sequence[str]
) -> DataFrame:
    """The same for sentences with very many words: terms carry only `norm`.

    `counts` holds `tf` once per sentence; it is joined word by word.
    """
    met = candidate_triples(terms, index.vectors)
    found = met.select(*sentence, "group_no", "norm", *TRIPLE, "triple_norm")
    words = met.select(*sentence, *TRIPLE, "triple_words").dropDuplicates([*sentence, *TRIPLE])
    words = words.select(*sentence, *TRIPLE, F.explode("triple_words").alias("word"))
    tf = counts.select(*sentence, F.explode("tf").alias("word", "n"))
    dots = (
        words.join(tf, [*sentence, "word"])
        .groupBy(*sentence, *TRIPLE)
        .agg(F.sum("n").alias("dot"))
    )
    scored = found.join(dots, [*sentence, *TRIPLE], "left")
    score = V.cosine_from_counts(
        F.coalesce("dot", F.lit(0)), F.col("norm"), F.col("triple_norm")
    )
    return scored.select(*sentence, "group_no", *TRIPLE, score.alias("score"))


def _mentioned(index: EdgeIndex, terms: DataFrame) -> EdgeIndex:
    """The index with the vectors of mentioned starts only: the others need not be shuffled."""
    starts = written(terms.select(F.col("term").alias("start")).distinct(), "mentioned")
    vectors = index.vectors.join(broadcast_if_small(starts), "start", "left_semi")
    return replace(index, vectors=vectors)


def _split_sentences(
    messages: DataFrame,
    keys: Sequence[str],
    text: str,
    stop_words: Sequence[str],
    long_words: int,
) -> tuple[DataFrame, DataFrame]:
    """Counted sentences, spread by key: those of usual length, and the long ones."""

    def analysed(part: DataFrame, is_long: bool) -> DataFrame:
        spread = part.select(*keys, text).repartition(shuffle_partitions(part), *keys)
        sents = message_sentences(spread, keys, text, stop_words)
        # on the plain word list: a filter on the counts would be pushed into their making
        fits = F.size("words") > long_words
        sents = sents.filter((F.size("runs") > 0) & (fits if is_long else ~fits))
        return sentence_counts(sents.drop("sentence"))

    # n words need at least 2n - 1 characters
    candidates = messages.filter(F.length(text) > 2 * long_words)
    return analysed(messages, False), analysed(candidates, True)


def rank_dense(
    terms: DataFrame,
    vectors: DataFrame,
    index: DenseIndex,
    keys: Sequence[str],
    bag: bool = True,
) -> DataFrame:
    """Ranked triples of lookup terms (keys, sent_no, group_no, term) by vectors of their sentences."""
    group = [*keys, "sent_no", "group_no"]
    if not bag:
        terms = terms.dropDuplicates([*group, "term"])
    scored = dense_candidates(terms, vectors, index, [*keys, "sent_no"], group)
    ranked = top_triples(scored, group, index.k, bag)
    return ranked.select(*group, "rank", *TRIPLE, "score")


def _dense_knowledge(
    messages: DataFrame,
    index: DenseIndex,
    keys: Sequence[str],
    text: str,
    stop_words: Sequence[str],
    lemma: Lemma | None,
    bag: bool,
) -> DataFrame:
    """Sentences are cut once and written; terms and vectors are made from that table."""
    spread = messages.select(*keys, text).repartition(shuffle_partitions(messages), *keys)
    sents = message_sentences(spread, keys, text, stop_words).filter(F.size("runs") > 0)
    return rank_sentences(written(sents, "sentences"), index, keys, lemma, bag)


def annotated_knowledge(
    annotation: Annotation,
    index: EdgeIndex | DenseIndex,
    keys: Sequence[str],
    bag: bool = True,
    long_words: int = LONG_WORDS,
) -> DataFrame:
    """`message_knowledge` for messages that an outside annotator has cut into tokens and chunks."""
    sentence = [*keys, "sent_no"]
    terms = written(annotated_terms(annotation, keys), "terms")
    if isinstance(index, DenseIndex):
        vectors = index.encode(annotated_sentences(annotation, keys), sentence, "sentence")
        return rank_dense(terms, written(vectors, "vectors"), index, keys, bag)
    counts = written(annotated_counts(annotation, keys), "counts")
    fits = F.size("tf") <= long_words
    fitting = staged_counts(counts.filter(fits), index)
    short = short_scores(terms.join(fitting, sentence), index, sentence)
    long = counts.filter(~fits)
    long_terms = terms.join(long.drop("tf"), sentence)
    rest = long_scores(long_terms, long, _mentioned(index, long_terms), sentence)
    group = [*sentence, "group_no"]
    columns = [*group, *TRIPLE, "score"]
    scored = by_message(short.select(*columns).unionByName(rest.select(*columns)), index, keys)
    ranked = top_triples(scored, group, index.k, bag)
    return ranked.select(*group, "rank", *TRIPLE, "score")


def message_knowledge(
    messages: DataFrame,
    index: EdgeIndex | DenseIndex,
    keys: Sequence[str],
    text: str = "text",
    stop_words: Sequence[str] = T.STOP_WORDS,
    lemma: Lemma | None = None,
    bag: bool = True,
    long_words: int = LONG_WORDS,
    annotator: Annotator | None = None,
) -> DataFrame:
    """Ranked triples of every message: (keys, sent_no, group_no, rank, triple, score).

    Messages are spread by key once, as plain text. While the edges are small
    enough to be broadcast nothing after that is shuffled: groups and messages
    are already together. Sentences with more than `long_words` words take a way
    of their own, so that no row grows with the square of a sentence.

    With a `DenseIndex` sentences and triples are compared by the vectors of its encoder. An
    `annotator` takes the place of the library's own words, groups, stop words and lemmas.
    """
    if annotator:
        spread = messages.select(*keys, text).repartition(shuffle_partitions(messages), *keys)
        messages = written(spread, "messages")
        return annotated_knowledge(annotator(messages, keys, text), index, keys, bag, long_words)
    if isinstance(index, DenseIndex):
        return _dense_knowledge(messages, index, keys, text, stop_words, lemma, bag)
    # The slim rows are read by both ways, the source they come from once.
    messages = written(messages.select(*keys, text), "messages")
    short, long = _split_sentences(messages, keys, text, stop_words, long_words)
    group = [*keys, "sent_no", "group_no"]

    def best(scored: DataFrame) -> DataFrame:
        ranked = top_triples(scored, group, index.k, bag)
        return ranked.select(*group, "rank", *TRIPLE, "score")

    short, long = staged_counts(short, index), written(long, "long")
    terms = sentence_terms(short, keys, lemma, carry=("tf", "norm"))
    long_terms = sentence_terms(long, keys, lemma, carry=("norm",))
    # a sentence is in one part only, so each part can be ranked by itself; the few long ones
    # are then put where their message is, which leaves the union spread by key
    rest = best(long_scores(long_terms, long, _mentioned(index, long_terms), [*keys, "sent_no"]))
    found = by_message(short_scores(terms, index, [*keys, "sent_no"]), index, keys)
    return best(found).unionByName(
        rest.repartition(shuffle_partitions(messages), *keys)
    )


def extract_knowledge(
    messages: DataFrame,
    index: EdgeIndex | DenseIndex,
    keys: Sequence[str],
    text: str = "text",
    stop_words: Sequence[str] = T.STOP_WORDS,
    lemma: Lemma | None = None,
    bag: bool = True,
    annotator: Annotator | None = None,
) -> DataFrame:
    """Every message with its `triples`, an empty list where nothing was found."""
    ranked = message_knowledge(
        messages, index, keys, text, stop_words, lemma, bag, annotator=annotator
    )
    found = knowledge_arrays(ranked, keys)
    joined = messages.join(found, list(keys), "left")
    nothing = F.array().cast(found.schema["triples"].dataType)
    return joined.withColumn("triples", F.coalesce("triples", nothing))


def context_knowledge(
    turns: DataFrame,
    index: EdgeIndex | DenseIndex,
    conv: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    stop_words: Sequence[str] = T.STOP_WORDS,
    lemma: Lemma | None = None,
    long_words: int = LONG_WORDS,
) -> DataFrame:
    """Knowledge from the whole dialogue so far, as what each turn adds to it.

    A word is looked up once per conversation, so the groups of an early turn do
    not change when later turns join the context. What is known at turn t is
    thus every row with a turn up to t; no history is ever copied.
    """
    keys = [conv, turn]
    sentence = [*keys, "sent_no"]
    group = [*sentence, "group_no"]
    # turns are parsed once; the words to look up and the counts both come from this table
    spread = turns.select(*keys, text).repartition(shuffle_partitions(turns), *keys)
    sents = message_sentences(spread, keys, text, stop_words, dedupe=False)
    sents = written(sents.filter(F.size("runs") > 0), "sentences")
    fresh = first_mention(run_tokens(sents, keys), [conv], [turn, "sent_no", "group_no", "pos"])
    named = fresh.withColumn("term", lemma(F.col("surface")) if lemma else F.col("surface"))
    terms = group_terms(named, group)
    if isinstance(index, DenseIndex):
        vectors = index.encode(sents, sentence, "sentence")
        return first_known(rank_dense(terms, written(vectors, "vectors"), index, keys), conv, turn)
    terms = written(terms, "terms")
    short, long = _counted(sents.drop("runs"), long_words)
    short = staged_counts(short, index)
    short_terms = terms.join(short, sentence)
    long_terms = terms.join(long.drop("tf"), sentence)
    columns = [*group, *TRIPLE, "score"]
    scored = short_scores(short_terms, index, sentence).select(*columns)
    rest = long_scores(long_terms, long, _mentioned(index, long_terms), sentence).select(*columns)
    scored = by_message(scored.unionByName(rest), index, keys)
    return first_known(top_triples(scored, group, index.k), conv, turn)


def first_known(ranked: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Where in its conversation each triple was found first."""
    place = [turn, "sent_no", "group_no", "rank"]
    first = F.min(F.struct(*place, "score")).alias("p")
    return ranked.groupBy(conv, *TRIPLE).agg(first).select(
        conv, *[f"p.{c}" for c in place], *TRIPLE, "p.score"
    )


def _counted(sents: DataFrame, long_words: int) -> tuple[DataFrame, DataFrame]:
    """Cut sentences with word counts: those of usual length, and the long ones.

    The long ones are written: a join word by word would else ask the size of a map of every
    sentence, which is made anew for each look at it, before the number of words is looked at.
    """
    fits = F.size("words") <= long_words
    rows = sents.drop("sentence")
    return sentence_counts(rows.filter(fits)), written(sentence_counts(rows.filter(~fits)), "long")


def rank_sentences(
    sents: DataFrame,
    index: EdgeIndex | DenseIndex,
    keys: Sequence[str],
    lemma: Lemma | None = None,
    bag: bool = True,
    long_words: int = LONG_WORDS,
) -> DataFrame:
    """Ranked triples of cut sentences (keys, sent_no, sentence, words, runs), as `message_knowledge`."""
    group = [*keys, "sent_no", "group_no"]
    if isinstance(index, DenseIndex):
        vectors = index.encode(sents, [*keys, "sent_no"], "sentence")
        return rank_dense(sentence_terms(sents, keys, lemma), written(vectors, "vectors"), index, keys, bag)
    short, long = _counted(sents, long_words)
    short = staged_counts(short, index)
    columns = [*group, *TRIPLE, "score"]
    short_terms = sentence_terms(short, keys, lemma, carry=("tf", "norm"))
    scored = short_scores(short_terms, index, [*keys, "sent_no"])
    long_terms = sentence_terms(long, keys, lemma, carry=("norm",))
    rest = long_scores(long_terms, long, _mentioned(index, long_terms), [*keys, "sent_no"])
    scored = by_message(scored.select(*columns).unionByName(rest.select(*columns)), index, keys)
    ranked = top_triples(scored, group, index.k, bag)
    return ranked.select(*group, "rank", *TRIPLE, "score")
