"""One registered query per operator or operator family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import knowledge_text as KT
from lorewell.functions.labels import relation_phrase, relation_token, triple_key, triple_text
from lorewell.functions.lines import truncate_words
from lorewell.functions.text import plural_lemma
from lorewell.functions.vectors import rounded
from lorewell.operators import annotated as N
from lorewell.operators import augment as A
from lorewell.operators import dense as D
from lorewell.operators import edges as E
from lorewell.operators import examples as X
from lorewell.operators import knowledge as K
from lorewell.operators import mixture as M
from lorewell.operators import terms as T
from lorewell.operators.backport import backport_concepts
from lorewell.operators.scratch import scratch_path, shuffle_partitions, written
from lorewell.plans import fixtures as fx
from lorewell.plans import jobs as J
from lorewell.sources import assertions as SA
from lorewell.sources import dialogs as SD
from lorewell.streaming.context import context_stream, read_context
from lorewell.streaming.turns import augment_turn_stream, read_augmented

Query = Callable[[SparkSession, str], DataFrame]
TURN = ("conv_id", "turn")
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# --- shared inputs ---------------------------------------------------------


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "conversations")


def spread_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the turns, dealt out evenly however few files hold them."""
    turns = conversations(spark, sf_dir).select(*TURN, "text")
    return turns.repartition(shuffle_partitions(turns))


def turn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as a stream, whether their table is one file or a folder of files."""
    turns = conversations(spark, sf_dir)
    reader = spark.readStream.schema(turns.schema)
    if all(f.endswith("/conversations.parquet") for f in turns.inputFiles()):
        stream = reader.option("pathGlobFilter", "conversations.parquet").parquet(sf_dir)
    else:
        stream = reader.parquet(f"{sf_dir}/conversations.parquet")
    return stream.select(*TURN, "text")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.assertions(fx.table(spark, sf_dir, "documents"))


def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English edges of weight 1 and more, with labels."""
    english = E.english_edges(assertions(spark, sf_dir))
    return E.with_labels(E.min_weight(E.with_weight(english)))


def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed edges of the top relations, stem test included.

    The language filter is taken to the scan: an assertion has the language of its document.
    """
    documents = fx.table(spark, sf_dir, "documents").filter(F.col("lang") == "en")
    weighted = E.min_weight(E.with_weight(E.english_edges(fx.assertions(documents))))
    kept = E.drop_same_stem(E.with_labels(weighted))
    edges = written(kept.select("uri", "relation", "start", "end", "weight"), "filtered")
    return E.collapse_edges(E.restrict_relations(edges, E.top_relations(edges)))


def edge_index(spark: SparkSession, sf_dir: str) -> K.EdgeIndex:
    return K.build_index(knowledge_base(spark, sf_dir))


def dense_index(spark: SparkSession, sf_dir: str) -> D.DenseIndex:
    """Sentences and triples as sums of word vectors of 64 components; edges of mentioned starts."""
    sents = T.message_sentences(conversations(spark, sf_dir), TURN)
    mentioned = T.sentence_terms(sents, TURN, plural_lemma).select(F.col("term").alias("start")).distinct()
    edges = knowledge_base(spark, sf_dir).join(mentioned, "start", "left_semi")
    edges = written(edges, "edges")
    embeddings = fx.table(spark, sf_dir, "embeddings")
    words = written(fx.word_vectors(conversations(spark, sf_dir), edges, embeddings), "words")
    return D.index_dense_edges(edges, D.word_sum_encoder(words, 64))


# --- knowledge base --------------------------------------------------------


@query
def kb_english_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = weighted_edges(spark, sf_dir)
    return edges.select("uri", "relation", "start", "end", "weight")


@query
def kb_relation_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.relation_share(weighted_edges(spark, sf_dir))


@query
def kb_top_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = E.top_relations(weighted_edges(spark, sf_dir))
    return E.relation_special_tokens(top)


@query
def kb_restricted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = written(weighted_edges(spark, sf_dir), "weighted")
    kept = E.restrict_relations(edges, E.top_relations(edges))
    return kept.select(
        "uri",
        relation_token("relation").alias("token"),
        relation_phrase("relation").alias("phrase"),
        "weight",
    )


@query
def kb_collapsed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.collapse_edges(weighted_edges(spark, sf_dir))


@query
def kb_triple_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = weighted_edges(spark, sf_dir).select("start", "relation", "end").distinct()
    return triples.select(
        triple_key("start", "relation", "end").alias("triple_key"),
        triple_text("start", "relation", "end").alias("triple_text"),
    )


@query
def kb_stem_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = weighted_edges(spark, sf_dir)
    labels = edges.select(F.explode(F.array("start", "end")).alias("label"))
    return E.stem_labels(labels)


@query
def kb_drop_same_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = E.drop_same_stem(weighted_edges(spark, sf_dir))
    return edges.select("uri", "start", "end", "weight")


@query
def kb_drop_inverse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = E.collapse_edges(weighted_edges(spark, sf_dir))
    return E.drop_inverse_pairs(edges).select("start", "relation", "end", "weight")


# --- text ------------------------------------------------------------------


@query
def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sentences(conversations(spark, sf_dir), TURN)


@query
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = T.tokens(conversations(spark, sf_dir), TURN)
    kept = T.first_mention(table, TURN, ["sent_no", "group_no", "pos"])
    return kept.select(*TURN, "sent_no", "group_no", "pos", "surface")


@query
def text_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir)
    table = T.lemmas(T.tokens(turns, TURN), fx.lemma_table(turns))
    return table.groupBy(*TURN, "term").agg(F.count("*").alias("n"))


@query
def text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = T.message_sentences(conversations(spark, sf_dir), TURN)
    terms = T.sentence_terms(sents, TURN, plural_lemma)
    return terms.select(*TURN, "sent_no", "group_no", "term")


# --- knowledge -------------------------------------------------------------


@query
def candidate_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = T.message_sentences(spread_turns(spark, sf_dir), TURN)
    terms = T.sentence_terms(sents, TURN, plural_lemma)
    terms = written(terms, "terms")
    edges = written(knowledge_base(spark, sf_dir), "edges")
    found = K.candidate_triples(terms, edges, K.spread_starts(terms, edges))
    return found.select(*TURN, "sent_no", "group_no", "term", "relation", "end", "weight")


@query
def score_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = T.message_sentences(conversations(spark, sf_dir), TURN)
    counts = T.sentence_counts(sents.drop("sentence"))
    terms = T.sentence_terms(counts, TURN, plural_lemma, carry=("tf", "norm"))
    edges = K.triple_vectors(knowledge_base(spark, sf_dir))
    scored = K.sparse_scores(K.candidate_triples(terms, edges))
    return scored.select(
        *TURN, "sent_no", "group_no", "start", "relation", "end", rounded(F.col("score")).alias("score")
    )


@query
def score_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = vectors.select(
        "vec_id",
        F.col("embedding").alias("vec"),
        F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 8)).alias("other_id"),
    )
    others = vectors.select(
        F.col("vec_id").alias("other_id"), F.col("embedding").alias("other_vec")
    )
    scored = K.dense_scores(near.join(others, "other_id"), "vec", "other_vec")
    best = K.top_triples(scored, ["vec_id"], k=3, order=("other_id",))
    return best.select("vec_id", "rank", "other_id", F.round("score", 6).alias("score"))


@query
def extract_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = edge_index(spark, sf_dir)
    ranked = K.message_knowledge(conversations(spark, sf_dir), index, TURN, lemma=plural_lemma)
    rows = K.distinct_triples(ranked, TURN)
    return rows.withColumn("score", F.round("score", 6))


@query
def extract_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = dense_index(spark, sf_dir)
    ranked = K.message_knowledge(conversations(spark, sf_dir), index, TURN, lemma=plural_lemma)
    rows = K.distinct_triples(ranked, TURN)
    return rows.withColumn("score", F.round("score", 6))


@query
def extract_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and spans as an annotator would deliver them give what the library's own words give."""
    ranked = K.message_knowledge(
        conversations(spark, sf_dir),
        edge_index(spark, sf_dir),
        TURN,
        annotator=N.run_annotator(lemma=plural_lemma),
    )
    rows = K.distinct_triples(ranked, TURN)
    return rows.withColumn("score", F.round("score", 6))


@query
def annotated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of chunks whose words but the last are compounds, and of the gaps between them."""
    found = fx.compounds(N.run_annotator(lemma=plural_lemma)(conversations(spark, sf_dir), TURN, "text"), TURN)
    terms = N.annotated_terms(found, TURN)
    return terms.select(*TURN, "sent_no", "group_no", "term")


@query
def extract_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = edge_index(spark, sf_dir)
    rows = K.context_knowledge(conversations(spark, sf_dir), index, lemma=plural_lemma)
    return rows.withColumn("score", F.round("score", 6))


# --- augmentation ----------------------------------------------------------


@query
def augment_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir).select(*TURN, "text")
    return A.augment_turns(turns, edge_index(spark, sf_dir), lemma=plural_lemma)


@query
def augment_convai(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.convai_lines(conversations(spark, sf_dir))
    out = A.augment("convai", lines, edge_index(spark, sf_dir), plural_lemma)
    return out.select("file", "line_no", "line")


@query
def augment_bst(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.bst_lines(conversations(spark, sf_dir))
    out = A.augment("bst", lines, edge_index(spark, sf_dir), plural_lemma)
    return out.select("file", "line_no", "line")


@query
def augment_ed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.ed_lines(conversations(spark, sf_dir))
    out = A.augment("empathy", lines, edge_index(spark, sf_dir), plural_lemma)
    return out.select("file", "line_no", "line")


@query
def augment_wow(spark: SparkSession, sf_dir: str) -> DataFrame:
    episodes = fx.wow_episodes(conversations(spark, sf_dir))
    out = A.augment_wow(
        episodes, edge_index(spark, sf_dir), plural_lemma, keys=("conv_id", "part")
    )
    said = F.transform(
        "dialog", lambda e: F.concat(e["speaker"], F.lit(":"), e["text"], e["concepts"])
    )
    return out.select("conv_id", "part", "chosen_topic", F.array_join(said, "\n").alias("dialog"))


@query
def backport(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir)
    lines = fx.bst_lines(turns, concepts=True)
    return backport_concepts(lines, fx.bst_episodes(turns), order=("conv_id", "part"))


@query
def stream_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir).select(*TURN, "text")
    stream = turn_stream(spark, sf_dir)
    sink = scratch_path(spark, "augmented")
    run = augment_turn_stream(
        stream,
        edge_index(spark, sf_dir),
        sink,
        scratch_path(spark, "progress"),
        lemma=plural_lemma,
    )
    run.awaitTermination()
    return read_augmented(turns, sink).drop("batch_id")


@query
def stream_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = turn_stream(spark, sf_dir)
    sink = scratch_path(spark, "context")
    run = context_stream(
        stream, edge_index(spark, sf_dir), sink, scratch_path(spark, "progress"), lemma=plural_lemma
    )
    run.awaitTermination()
    return read_context(spark, sink).withColumn("score", F.round("score", 6))


# --- examples --------------------------------------------------------------


@query
def bst_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.bst_lines(conversations(spark, sf_dir), concepts=True, broken=True)
    return X.bst_examples(lines).withColumn("labels", F.array_join("labels", "|"))


@query
def episode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.bst_lines(conversations(spark, sf_dir), concepts=True, broken=True)
    return X.episode_stats(X.bst_examples(lines))


@query
def validate_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.bst_lines(conversations(spark, sf_dir), broken=True)
    checked = X.validate_examples(lines)
    return checked.select("file", "line_no", F.array_join("errors", "; ").alias("errors"))


@query
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that break a rule, beside the counts observed while all lines were written."""
    lines = fx.bst_lines(conversations(spark, sf_dir), concepts=True, faults=True)
    out = scratch_path(spark, "validated")
    counts = J.write_validated(lines, out)
    bad = J.read_validated(spark, out, "quarantine")
    seen = [F.lit(n).cast("bigint").alias(f"n_{name}") for name, n in counts.items()]
    return bad.select("file", "line_no", F.array_join("errors", "; ").alias("errors"), *seen)


@query
def ed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.ed_lines(conversations(spark, sf_dir), concepts=True)
    rows = X.ed_examples(X.pair_turns(lines))
    return rows.withColumn("candidates", F.array_join("candidates", "|"))


@query
def wow_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    episodes = fx.wow_episodes(conversations(spark, sf_dir), concepts=True)
    rows = X.wow_examples(episodes, "wizard", add_topic=True, keys=("conv_id", "part"))
    return rows.withColumn("labels", F.array_join("labels", "|"))


@query
def convai_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.convai_examples(fx.convai_lines(conversations(spark, sf_dir)))
    return rows.withColumns(
        {
            "labels": F.array_join("labels", "|"),
            "label_candidates": F.array_join("label_candidates", "|"),
        }
    )


@query
def row_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.ed_lines(conversations(spark, sf_dir), concepts=True)
    vectors = fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row"), "embedding"
    )
    out = X.attach_row_vectors(X.pair_turns(lines), vectors)

    def code(vec: str) -> Column:
        """One whole number from all components."""
        weighed = F.transform(vec, lambda x, i: F.floor(x.cast("double") * 256) * (i + 1))
        return F.aggregate(weighed, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return out.select(
        "file", "line_no", code("context_vec").alias("context_code"), code("label_vec").alias("label_code")
    )


@query
def label_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.posexplode("embedding").alias("d", "v"),
    )
    scores = scores.select(
        "id",
        F.concat(F.lit("__label__l"), F.lpad(F.col("d").cast("string"), 2, "0")).alias("label"),
        F.col("v").cast("double").alias("score"),
    )
    prefix = X.top_label_prefix(scores, k=3)
    turns = conversations(spark, sf_dir)
    joined = turns.join(prefix, turns["conv_id"] == prefix["id"], "left")
    text = F.concat(F.coalesce("prefix", F.lit("")), "text")
    return joined.select(*TURN, text.alias("text"))


@query
def sample_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir)
    openings = turns.filter(F.col("turn") == 0)
    contexts = openings.select(F.col("conv_id").alias("context_id"), F.col("text").alias("context"))
    episodes = openings.select(F.col("conv_id").alias("episode_id"))
    return X.sample_contexts(episodes, contexts, seed=7)


def mixture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, id): the turns dealt to the datasets of the mixture."""
    names = F.array(*[F.lit(n) for n in M.LARGE_MIXTURE])
    return conversations(spark, sf_dir).select(
        F.element_at(names, (F.col("conv_id") % 4 + 1).cast("int")).alias("dataset"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
    )


@query
def mix_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mix_datasets(mixture_rows(spark, sf_dir), M.LARGE_MIXTURE, seed=7)


@query
def interleave_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture in an order that holds its weights in every stretch."""
    mixed = M.mix_datasets(mixture_rows(spark, sf_dir), M.LARGE_MIXTURE, seed=7, positions=True)
    return M.training_order(mixed).select("position", "dataset", "id", "copy")


@query
def truncate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir).select(*TURN, "text")
    out = M.history_text(turns, max_words=32)
    return out.select(*TURN, "history", truncate_words("text", 12, "right").alias("label"))


@query
def knowledge_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both text forms of a turn's knowledge, and the items read back from them."""
    found = K.extract_knowledge(
        conversations(spark, sf_dir).select(*TURN, "text"),
        edge_index(spark, sf_dir),
        TURN,
        lemma=plural_lemma,
    )
    cells = found.select(
        *TURN,
        KT.render_list("triples").alias("listed"),
        KT.render_enveloped("triples").alias("enveloped"),
    )
    return cells.select(
        *TURN,
        "listed",
        F.size(KT.parse_items("listed")).cast("bigint").alias("n_listed"),
        F.size(KT.parse_items("enveloped")).cast("bigint").alias("n_enveloped"),
    )


# --- sources and sinks -----------------------------------------------------


@query
def io_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump in a folder per language, numbered in one scan."""
    rows = assertions(spark, sf_dir)
    uri = fx.assertion_uri()
    line = F.concat_ws("\t", *[uri if c == "uri" else c for c in rows.columns])
    dump = rows.drop("uri").withColumns(
        {"lang": F.regexp_extract("start_uri", "^/c/([a-z]+)/", 1), "file": F.lit("dump")}
    )
    path = scratch_path(spark, "dump")
    SD.write_dialog_lines(
        dump, path, partition_by=("lang",), line_no=uri, line=line, compression="gzip"
    )
    back = SA.read_assertions(spark, path, numbered=True, folder_is_file=True)
    return back.select(
        F.regexp_extract("file", "([^/=]*)$", 1).alias("file"), "line_no", "uri", "relation", "start_uri", "end_uri",
        F.get_json_object("extra", "$.weight").cast("double").alias("weight"),
    )


@query
def io_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered edges written with a header and read back."""
    edges = E.min_weight(E.with_weight(E.english_edges(assertions(spark, sf_dir))))
    path = scratch_path(spark, "edges")
    SA.write_edges(edges.select("uri", "relation", "start_uri", "end_uri", "extra", "weight"), path, "csv")
    back = SA.read_edges(spark, path, "csv")
    weighed = F.get_json_object("extra", "$.weight").cast("double").alias("raw_weight")
    return back.select("uri", "relation", "start_uri", "end_uri", weighed, "weight")


@query
def io_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output for each dialogue file, read back under the files' own names."""
    path = scratch_path(spark, "files")
    SD.write_line_files(fx.ed_lines(conversations(spark, sf_dir)), path)
    return SD.read_line_files(spark, path)


@query
def io_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two splits are laid out, one is replaced by marked lines; both are read back."""
    lines = written(fx.bst_lines(conversations(spark, sf_dir)), "lines")
    path = scratch_path(spark, "layout")
    even = F.substring("file", 2, 20).cast("bigint") % 2 == 0
    named = lines.withColumns(
        {"dataset": F.lit("bst"), "split": F.when(even, "train").otherwise("valid"), "variant": F.lit("plain")}
    )
    SD.write_dialog_lines(named, path, partition_by=SD.LAYOUT)
    again = named.filter("split = 'train'").withColumn("line", F.concat(F.lit("again "), "line"))
    SD.write_dialog_lines(again, path, partition_by=SD.LAYOUT)
    found = [
        SD.read_layout(spark, path, "bst", split).select(F.lit(split).alias("split"), "line_no", "line")
        for split in ("train", "valid")
    ]
    return found[0].unionByName(found[1])


@query
def io_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one JSON array each, read by many tasks."""
    path = scratch_path(spark, "arrays")
    fx.array_files(fx.wow_episodes(conversations(spark, sf_dir)), path)
    schema = "conv_id bigint, chosen_topic string, dialog array<struct<speaker: string, text: string>>"
    episodes = SD.read_dialog_json(spark, path, schema)
    said = F.transform("dialog", lambda e: F.concat_ws(":", e["speaker"], e["text"]))
    return episodes.select(
        "conv_id", "chosen_topic", F.size("dialog").cast("bigint").alias("n"), F.array_join(said, "\n").alias("dialog")
    )
