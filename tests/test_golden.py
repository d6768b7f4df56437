"""Hand-worked cases, one or more per operator."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lorewell.functions import knowledge_text as KT
from lorewell.functions import labels, lines
from lorewell.functions.porter2 import stem
from lorewell.functions.text import plural_lemma, sentences
from lorewell.functions.vectors import cosine_from_counts, dense_cosine
from lorewell.operators import augment as A
from lorewell.operators import edges as E
from lorewell.operators import examples as X
from lorewell.operators import knowledge as K
from lorewell.operators import mixture as M
from lorewell.operators import terms as T
from lorewell.operators.backport import backport_concepts

K1, K2 = "__knowledge__", "__endknowledge__"


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)]
    return spark.range(1).select(*cols).select(column.alias("x")).first()["x"]


def line_table(spark, *rows):
    return spark.createDataFrame(
        [("f", i + 1, r) for i, r in enumerate(rows)], "file string, line_no long, line string"
    )


def edge_index(spark, *triples, k=3, limit=None):
    rows = [(s, e, f"/r/{r}", 1.0) for s, r, e in triples]
    edges = spark.createDataFrame(rows, "start string, end string, relation string, weight double")
    return K.index_edges(edges, k, limit)


def texts(df, *order):
    return [r["line"] for r in df.orderBy(*(order or ("line_no",))).collect()]


def test_concept_label(spark):
    for uri, label in [
        ("/c/en/hot_dog/n/wn/food", "hot dog"),
        ("/c/en/food", "food"),
        ("/c/fr/y", None),
    ]:
        assert one(spark, labels.concept_label("u"), u=uri) == label


def test_relation_forms(spark):
    assert one(spark, labels.relation_token("r"), r="/r/MotivatedByGoal") == "__MotivatedByGoal__"
    assert one(spark, labels.relation_phrase("r"), r="/r/MotivatedByGoal") == "Motivated By Goal"
    assert one(spark, labels.relation_phrase("r"), r="/r/IsA") == "Is A"


def test_triple_forms(spark):
    args = {"s": "hot dog", "r": "/r/IsA", "e": "food"}
    assert one(spark, labels.triple_key("s", "r", "e"), **args) == "hot dog__IsA__food"
    assert one(spark, labels.triple_text("s", "r", "e"), **args) == "hot dog Is A food"
    back = one(spark, labels.parse_triple(F.lit("hot dog__IsA__food")))
    assert (back["start"], back["relation"], back["end"]) == ("hot dog", "/r/IsA", "food")
    assert one(spark, labels.parse_triple(F.lit("hot dog Is A food"))) is None


def test_filters_of_the_knowledge_base(spark):
    rows = [
        ("1", "/r/IsA", "/c/en/dog", "/c/en/cat/n", '{"weight": 1.0}'),
        ("2", "/r/IsA", "/c/en/dog", "/c/en/bird", '{"weight": 0.99}'),
        ("3", "/r/IsA", "/c/en/run", "/c/en/running/v", '{"weight": 2}'),
        ("4", "/r/IsA", "/c/fr/chien", "/c/en/dog", '{"weight": 2}'),
        ("5", "/r/IsA", "/c/en/dog", "/c/en/dog/v", '{"weight": 2}'),
        ("6", "/r/IsA", "/c/en/dog", "/c/en/hot_dog", '{"other": 2}'),
    ]
    raw = spark.createDataFrame(
        rows, "uri string, relation string, start_uri string, end_uri string, extra string"
    )
    weighted = E.with_weight(E.english_edges(raw))
    assert {r["uri"] for r in E.without_weight(weighted).collect()} == {"6"}
    kept = E.drop_same_stem(E.with_labels(E.min_weight(weighted)))
    assert {r["uri"] for r in kept.collect()} == {"1"}


def test_stems_follow_the_published_examples():
    published = """consistency consist; consolations consol; consolatory consolatori;
    conspicuously conspicu; constancy constanc; knackeries knackeri; kneaded knead; knives knive;
    knightly knight; knitting knit; running run; hoping hope; hopping hop; generously generous;
    communism communism; national nation; happy happi; say say; by by; ties tie; cries cri;
    gas gas; this this; kiwis kiwi; agreed agre; feed feed; luxuriated luxuri; skies sky;
    dying die; proceeded proceed; hot dogs hot dog; 'tis tis; dog's dog"""
    for pair in published.replace("\n", " ").split(";"):
        *word, expected = pair.split()
        if len(word) > 1:
            word, expected = word[: len(word) // 2 + 1], " ".join([*word[2:], expected])
        assert stem(" ".join(word)) == expected, pair


def test_stem_keeps_the_first_letter():
    for word in ["skies", "dying", "'twas", "yes", "abed", "oing", "eed", "ies", "ing", "as"]:
        assert stem(word)[:1] == word.removeprefix("'")[:1]


def relations(spark, **counts):
    rows = [(f"/r/{r}",) for r, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "relation string")


def test_relation_share(spark):
    got = {r["relation"]: r["share"] for r in E.relation_share(relations(spark, a=2, b=1, c=2)).collect()}
    assert got == {"/r/a": "40.0%", "/r/c": "40.0%", "/r/b": "20.0%"}


def test_excluded_relations_are_not_replaced(spark):
    top = E.top_relations(relations(spark, Synonym=4, IsA=3, UsedFor=2, HasA=1), n=3)
    assert [r["relation"] for r in top.orderBy("relation").collect()] == ["/r/IsA", "/r/UsedFor"]
    tokens = E.relation_special_tokens(top).select("token").collect()
    assert {r["token"] for r in tokens} == {"__IsA__", "__UsedFor__"}


def test_restrict_relations_by_list_and_table(spark):
    edges = relations(spark, a=2, b=1)
    only = spark.createDataFrame([("/r/b",)], "relation string")
    assert E.restrict_relations(edges, ["/r/b"]).count() == 1
    assert E.restrict_relations(edges, only).count() == 1


def test_last_edge_wins(spark):
    rows = [(1, "a", "b", "/r/IsA", 1.0), (2, "a", "b", "/r/UsedFor", 2.0)]
    labelled = spark.createDataFrame(
        rows, "ord long, start string, end string, relation string, weight double"
    )
    got = E.collapse_edges(labelled, "ord").collect()
    assert [tuple(r) for r in got] == [("a", "b", "/r/UsedFor", 2.0)]


def test_inverse_pairs(spark):
    rows = [("a", "/r/IsA", "b"), ("b", "/r/IsA", "a"), ("b", "/r/HasA", "a")]
    df = spark.createDataFrame(rows, "start string, relation string, end string")
    got = {tuple(r) for r in E.drop_inverse_pairs(df).select("start", "relation", "end").collect()}
    assert got == {("a", "/r/IsA", "b"), ("b", "/r/HasA", "a")}


def test_sentences(spark):
    text = "Hi there. How are you?? Fine\nok then!"
    assert one(spark, sentences("t"), t=text) == ["Hi there.", "How are you??", "Fine", "ok then!"]


def messages(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


def test_first_mention(spark):
    table = T.tokens(messages(spark, "Dogs bark. Dogs run."), ["id"])
    kept = T.first_mention(table, ["id"], ["sent_no", "group_no", "pos"])
    got = [(r["sent_no"], r["surface"]) for r in kept.orderBy("sent_no", "pos").collect()]
    assert got == [(0, "dogs"), (0, "bark"), (1, "run")]


def test_groups_end_at_stop_words_and_punctuation(spark):
    sents = T.message_sentences(messages(spark, "A hot-dog, the dog's bone of it"), ["id"])
    assert sents.first()["runs"] == [["hot", "dog"], ["s", "bone"]]
    assert sents.first()["words"] == ["hot", "dog", "dog", "s", "bone"]


def test_group_terms_and_lemma_table(spark):
    rows = [(0, 0, "hot"), (0, 1, "dogs"), (1, 0, "dogs")]
    table = spark.createDataFrame(rows, "group_no long, pos long, surface string")
    forms = spark.createDataFrame([("dogs", "dog")], "surface string, lemma string")
    terms = T.group_terms(T.lemmas(table, forms), ["group_no"])
    got = sorted((r["group_no"], r["term"]) for r in terms.collect())
    assert got == [(0, "dog"), (0, "hot"), (0, "hot dog"), (1, "dog")]


def scored(spark, *rows):
    return spark.createDataFrame(
        [(1, "c", "/r/IsA", e, s) for e, s in rows],
        "g long, start string, relation string, end string, score double",
    )


def test_repeats_take_up_places(spark):
    df = scored(spark, ("t1", 0.9), ("t1", 0.9), ("t2", 0.8), ("t3", 0.7))
    bag = K.top_triples(df, ["g"], 3).orderBy("rank").collect()
    assert [r["end"] for r in bag] == ["t1", "t1", "t2"]
    distinct = K.top_triples(df, ["g"], 3, bag=False).orderBy("rank").collect()
    assert [r["end"] for r in distinct] == ["t1", "t2", "t3"]


def test_zero_vectors(spark):
    zero, some = F.lit(0), F.lit(4)
    assert one(spark, cosine_from_counts(zero, zero, some)) == 0.0
    assert one(spark, dense_cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, dense_cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 1.0


def test_message_without_known_terms(spark):
    index = edge_index(spark, ("dog", "IsA", "animal"))
    rows = K.extract_knowledge(messages(spark, "nothing here", "a dog", ""), index, ["id"])
    got = {r["id"]: [tuple(t) for t in r["triples"]] for r in rows.collect()}
    assert got == {0: [], 1: [("dog", "/r/IsA", "animal")], 2: []}


def test_phrase_lookup_and_order(spark):
    index = edge_index(
        spark, ("hot dog", "IsA", "food"), ("dog", "HasA", "tail"), ("dog", "IsA", "friend")
    )
    rows = K.extract_knowledge(messages(spark, "A hot dog with a friend"), index, ["id"])
    ends = [t["end"] for t in rows.first()["triples"]]
    # friend shares two words with the sentence, food two as well but over a larger norm
    assert set(ends) == {"food", "tail", "friend"} and ends[-1] == "tail"


def test_convai_lines(spark):
    index = edge_index(spark, ("monkeys", "IsA", "animal"))
    lines_in = line_table(spark, "1 your persona: i like dogs.", "1 12 monkeys rule\tyes", "2 hm")
    out = A.augment_convai(lines_in, index)
    assert texts(out) == [
        "1 your persona: i like dogs.",
        f"1 12 monkeys rule{K1}monkeys__IsA__animal{K2}\tyes",
        "2 hm",
    ]
    assert [r["error"] for r in out.orderBy("line_no").collect()] == [None, None, "no tab in line"]
    assert one(spark, lines.numbered_query("l"), l="1 12 monkeys rule\tyes") == "monkeys rule"
    assert one(spark, lines.numbered_query("l", True), l="1 12 monkeys\tyes") == "12 monkeys"


def test_bst_lines(spark):
    index = edge_index(spark, ("dog", "IsA", "animal"))
    out = A.augment_bst(line_table(spark, "context:c\tfree_message:hi dog ", "text:x"), index)
    assert texts(out) == [
        f"context:c\tfree_message:hi dog\tconcepts:{K1}dog__IsA__animal{K2}",
        "text:x\tconcepts:",
    ]
    assert [r["error"] for r in out.orderBy("line_no").collect()] == [None, "no free_message"]


def test_ed_lines(spark):
    index = edge_index(spark, ("dog", "IsA", "animal, big"), ("ok", "IsA", "word"))
    out = A.augment("empathy", line_table(spark, "conv_id,x", "hit:1,2,sad,s,0,a dog_comma_ ok,x,"), index)
    assert texts(out) == [
        "conv_id,x,concepts",
        "hit:1,2,sad,s,0,a dog_comma_ ok,x,"
        f",{K1}dog__IsA__animal_comma_ big{K2}{K1}ok__IsA__word{K2}",
    ]


def test_wow_episodes(spark):
    index = edge_index(spark, ("dog", "IsA", "animal"))
    rows = [("f", 1, "Dogs", [("0_Wizard", "my dog"), ("1_Apprentice", "oh")])]
    episodes = spark.createDataFrame(
        rows,
        "file string, episode_id long, chosen_topic string, "
        "dialog array<struct<speaker: string, text: string>>",
    )
    out = A.augment_wow(episodes, index).first()
    assert [d["concepts"] for d in out["dialog"]] == [f"{K1}dog__IsA__animal{K2}", ""]
    assert out["chosen_topic"] == "Dogs"


def test_live_turns(spark):
    index = edge_index(spark, ("dog", "IsA", "animal"), ("dog", "HasA", "tail"))
    out = A.augment_turns(messages(spark, "dog", "no"), index, keys=("id",)).orderBy("id").collect()
    # "is", "a" and "has" are stop words: the norms are equal and the relation decides
    assert out[0]["text"] == f"dog\n{K1}dog Has A tail. dog Is A animal{K2}"
    assert out[1]["text"] == f"no\n{K1}{K2}"
    same = A.augment_turns(messages(spark, "dog"), index, keys=("id",), include_concepts=False)
    assert same.first()["text"] == "dog"


def episodes_with_concepts(spark, *episodes):
    return spark.createDataFrame(
        [("e", i, [["s", t] for t in d], c) for i, (d, c) in enumerate(episodes)],
        "file string, episode_id long, dialog array<array<string>>, concepts array<array<string>>",
    )


def test_backport_last_text_wins(spark):
    eps = episodes_with_concepts(spark, (["hi"], [["t1"]]), (["hi", "ho"], [["t2", "t|3"]]))
    lines_in = line_table(
        spark,
        "free_message:hi\tconcepts:old",
        "free_message:ho",
        "text:none",
        "free_message:hi\tfree_message:hi",
    )
    rows = backport_concepts(lines_in, eps).orderBy("line_no", "field_no").collect()
    assert [(r["line_no"], r["found"], r["line"]) for r in rows] == [
        (1, True, "free_message:hi\tconcepts:t2|t_pipe_3"),
        (2, False, None),
        (4, True, "free_message:hi\tfree_message:hi\tconcepts:t2|t_pipe_3"),
        (4, True, "free_message:hi\tfree_message:hi\tconcepts:t2|t_pipe_3"),
    ]


def test_fields(spark):
    fields = lines.tab_fields(F.lit("text:hi: there\tlabels:yo\tlabels:last"))
    assert one(spark, lines.field_value(fields, "text")) == "hi: there"
    assert one(spark, lines.field_value(fields, "labels")) == "last"
    assert one(spark, lines.field_value(fields, "labels", first=True)) == "yo"
    assert one(spark, lines.field_value(fields, "none")) is None


def test_validation(spark):
    bad = line_table(spark, "text:a\tlabels:b\tconcepts:\teval_labels:c", "text:a\tlabels:b", "")
    checked = X.validate_examples(bad)
    got = [r["errors"] for r in checked.orderBy("line_no").collect()]
    assert got == [["eval_labels in line 1"], ["missing concepts in line 2"]]
    with pytest.raises(PySparkException):
        X.raise_on_errors(checked).collect()


def test_episodes_and_stats(spark):
    def line(done):
        return "text:hi\tlabels:b|c\tconcepts:a Is A b|c Is A d" + "\tepisode_done:True" * done

    rows = X.bst_examples(line_table(spark, line(0), line(1), line(0)))
    got = rows.orderBy("line_no").collect()
    assert [(r["episode_id"], r["episode_done"]) for r in got] == [(0, False), (0, True), (1, True)]
    assert got[0]["text"] == f"hi\n{K1}a Is A b. c Is A d{K2}"
    assert got[0]["labels"] == ["b", "c"]
    stats = X.episode_stats(rows).first()
    assert (stats["n_examples"], stats["n_episodes"], stats["one_long_episode"]) == (3, 2, False)
    empty = X.bst_examples(line_table(spark, "text:hi\tlabels:b\tconcepts:")).first()
    assert empty["text"] == f"hi\n{K1}{K2}"


def test_an_invalid_line_still_ends_its_episode(spark):
    good, done = "text:hi\tlabels:b\tconcepts:", "\tepisode_done:True"
    rows = X.bst_examples(line_table(spark, good, "text:hi\tconcepts:" + done, good, good + done))
    got = [(r["line_no"], r["episode_id"], r["episode_done"]) for r in rows.orderBy("line_no").collect()]
    assert got == [(1, 0, True), (3, 1, False), (4, 1, True)]
    last = X.bst_examples(line_table(spark, good, "text:hi\tconcepts:"))
    assert [(r["episode_done"], r["n_lines"]) for r in last.collect()] == [(True, 2)]


def test_blanks_at_the_ends(spark):
    assert one(spark, lines.strip_space("t"), t="\u00a0 a\u00a0b \u2003\n") == "a\u00a0b"


def ed(spark, *turns):
    rows = ["conv_id,h"] + [f"{c},{t},p,s,0,{c}{t},x,,a|b" for c, t in turns]
    return line_table(spark, *rows)


def test_pairs_and_roles(spark):
    pairs = X.pair_turns(ed(spark, ("A", 1), ("A", 2), ("A", 3), ("B", 1)))
    rows = X.ed_examples(pairs).orderBy("line_no").collect()
    assert [(r["text"].split("\n")[0], r["label"], r["context_role"]) for r in rows] == [
        ("A1", "A2", "experiencer"),
        ("A2", "A3", "responder"),
    ]
    assert rows[0]["text"] == f"A1\n{K1}a. b{K2}"


def test_bad_runs_are_quarantined(spark):
    checked = X.check_turns(X.pair_turns(ed(spark, ("A", 1), ("A", 3), ("B", 1), ("B", 2))))
    assert [tuple(r)[1:3] for r in X.bad_runs(checked).collect()] == [(2, "turns out of order")]
    kept = X.ed_examples(X.pair_turns(ed(spark, ("A", 1), ("A", 3), ("B", 1), ("B", 2))))
    assert [r["label"] for r in kept.collect()] == ["B2"]
    # an id that comes back is another run
    again = X.pair_turns(ed(spark, ("A", 1), ("A", 2), ("B", 1), ("A", 1), ("A", 2)))
    assert sorted(r["run_start"] for r in again.collect()) == [2, 5]


def test_candidates(spark):
    def cands(*fields):
        return one(spark, X.ed_candidates(F.array(*[F.lit(f) for f in fields])))

    assert cands(*["x"] * 8, "a_comma_b|c_pipe_d", "k") == ["a,b", "c|d"]
    assert cands(*["x"] * 8, "", "k") == []
    assert cands(*["x"] * 9) == []
    short = line_table(spark, "h", "A,1,p,s,0,u,x,k", "A,2,p,s,0,u,x,k")
    assert X.check_turns(X.pair_turns(short)).first()["error"] == "wrong number of fields"


def test_political(spark):
    rows = line_table(
        spark, "h", "A,1,p,s,0,u,x,<POLITICAL>,k", "A,2,p,s,0,u,x,,k", "A,3,p,s,0,u,x,,k"
    )
    got = X.ed_examples(X.pair_turns(rows)).orderBy("line_no").collect()
    assert [r["is_political"] for r in got] == [True, False]


def test_row_vectors(spark):
    pairs = X.pair_turns(ed(spark, ("A", 1), ("A", 2), ("A", 3)))
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "row long, embedding array<double>")
    got = X.attach_row_vectors(pairs, vectors).orderBy("line_no").collect()
    assert [(r["context_vec"], r["label_vec"]) for r in got] == [([0.0], [1.0]), ([1.0], [2.0])]


def test_label_prefix(spark):
    rows = [(1, f"__label__{n}", s) for n, s in [("joy", 0.9), ("sad", 0.05), ("fear", 0.03), ("x", 0.01)]]
    scores = spark.createDataFrame(rows, "id long, label string, score double")
    assert X.top_label_prefix(scores, 3).first()["prefix"] == "fear sad joy "


def dialog(spark, *speakers, topic="Dogs"):
    rows = [("f", 0, topic, [(s, str(i), [f"k{i}"]) for i, s in enumerate(speakers)])]
    return spark.createDataFrame(
        rows,
        "file string, episode_id long, chosen_topic string, "
        "dialog array<struct<speaker: string, text: string, concepts: array<string>>>",
    )


def test_pair_dialog(spark):
    episode = dialog(spark, "0_Wizard", "1_Apprentice", "0_Wizard", "1_Apprentice")

    def pairs(speaker):
        rows = X.pair_dialog(episode, speaker).orderBy("entry_no").collect()
        return [(r["first"]["text"], r["second"]["text"], r["episode_done"]) for r in rows]

    assert pairs("wizard") == [("1", "2", True)]
    assert pairs("both") == [("0", "1", False), ("2", "3", True)]
    assert X.pair_dialog(dialog(spark, "0_Wizard"), "wizard").count() == 0


def test_wow_examples(spark):
    episode = dialog(spark, "0_Apprentice", "1_Wizard", "0_Apprentice", "1_Wizard")
    rows = X.wow_examples(episode, "wizard", add_topic=True).orderBy("entry_no").collect()
    assert [r["text"] for r in rows] == [f"Dogs\n0\n{K1}k0{K2}", f"2\n{K1}k2{K2}"]
    assert [r["labels"] for r in rows] == [["1"], ["3"]]
    assert rows[0]["chosen_topic"] == "Dogs"
    bare = X.wow_examples(dialog(spark, "a", "b", topic=None), add_topic=True).first()
    assert bare["text"] == f"\n0\n{K1}k0{K2}"


def test_convai_examples(spark):
    rows = line_table(spark, "1 your persona: x", "2 hi\tyo\t\ta|b", "1 new\tok\t\tc")
    got = X.convai_examples(rows).orderBy("line_no").collect()
    assert [(r["episode_id"], r["text"], r["labels"], r["label_candidates"]) for r in got] == [
        (0, "your persona: x", [], []),
        (0, "hi", ["yo"], ["a", "b"]),
        (1, "new", ["ok"], ["c"]),
    ]
    assert "label_candidates" not in X.convai_examples(rows, use_candidates=False).columns


def test_context_knowledge_grows(spark):
    index = edge_index(spark, ("dog", "IsA", "animal"), ("cat", "IsA", "pet"))
    turns = spark.createDataFrame(
        [(1, 0, "dog"), (1, 1, "a dog and cat"), (1, 2, "cat")], "conv_id long, turn long, text string"
    )
    got = sorted((r["turn"], r["start"]) for r in K.context_knowledge(turns, index).collect())
    assert got == [(0, "dog"), (1, "cat")]


def test_history_and_truncation(spark):
    turns = spark.createDataFrame(
        [(1, 0, "a b"), (1, 1, "c"), (1, 2, "d")], "conv_id long, turn long, text string"
    )
    got = {r["turn"]: r["history"] for r in M.history_text(turns).collect()}
    assert got == {0: "a b  __end__", 1: "a b  c  __end__", 2: "a b  c  d  __end__"}
    for block_rows in (1, 2, 100):
        cut = M.history_text(turns, end_token=None, max_words=3, block_rows=block_rows)
        assert {r["turn"]: r["history"] for r in cut.collect()} == {0: "a b", 1: "b  c", 2: "c  d"}
    gaps = spark.range(300).selectExpr("1L AS conv_id", "id * 10 AS turn", "string(id) AS text")
    whole = M.history_text(gaps, end_token=None).filter("turn = 2990").first()["history"]
    assert whole == "  ".join(map(str, range(300)))
    last = M.history_text(gaps, end_token=None, max_words=31, block_rows=7).filter("turn = 2990").first()
    assert last["history"] == "  ".join(map(str, range(284, 300)))
    assert one(spark, lines.truncate_words("t", 2, "left"), t="a b c") == "b c"
    assert one(spark, lines.truncate_words("t", 2, "right"), t="a b c") == "a b"
    assert one(spark, lines.truncate_words("t", 5, "left"), t="a b c") == "a b c"
    both = spark.createDataFrame([("a b c", "d e")], "text string, label string")
    cut = M.truncate_examples(both, {"text": 2, "label": 1}).first()
    assert (cut["text"], cut["label"]) == ("b c", "d")


def test_mixture_sizes(spark):
    rows = [("bst", f"b{i}") for i in range(70)] + [("wow", f"w{i}") for i in range(10)]
    mixed = M.mix_datasets(
        spark.createDataFrame(rows, "dataset string, id string"), {"bst": 1, "wow": 3}
    )
    counts = {r["dataset"]: r["count"] for r in mixed.groupBy("dataset").count().collect()}
    assert counts == {"bst": 20, "wow": 60}
    assert mixed.filter("dataset = 'wow'").groupBy("id").count().filter("count <> 6").count() == 0
    assert mixed.filter("dataset = 'bst' and copy > 0").count() == 0


def test_contexts_are_drawn_again_alike(spark):
    episodes = spark.range(50).withColumnRenamed("id", "episode_id")
    contexts = spark.range(7).select(F.col("id").alias("context_id"))
    first = {tuple(r) for r in X.sample_contexts(episodes, contexts, 1).collect()}
    second = {tuple(r) for r in X.sample_contexts(episodes.repartition(5), contexts, 1).collect()}
    assert first == second and len(first) == 50
    assert len({c for _, c in first}) > 3


def test_knowledge_cells(spark):
    triples = F.array(
        F.struct(F.lit("a").alias("start"), F.lit("/r/IsA").alias("relation"), F.lit("b").alias("end")),
        F.struct(F.lit("c").alias("start"), F.lit("/r/HasA").alias("relation"), F.lit("d|e").alias("end")),
    )
    assert one(spark, KT.render_list(triples)) == "a Is A b|c Has A d_pipe_e"
    assert one(spark, KT.render_enveloped(triples)) == f"{K1}a__IsA__b{K2}{K1}c__HasA__d_pipe_e{K2}"
    assert one(spark, KT.parse_items(KT.render_enveloped(triples))) == ["a__IsA__b", "c__HasA__d_pipe_e"]
    assert one(spark, KT.parse_items(F.lit("x|y"))) == ["x", "y"]
    assert one(spark, KT.parse_items(F.lit(None).cast("string"))) == []
    skipped = KT.append_knowledge(F.lit("t"), F.array().cast("array<string>"), skip_empty=True)
    assert one(spark, skipped) == "t"


def test_plural_lemma(spark):
    assert one(spark, plural_lemma(F.col("w")), w="stands") == "stand"
    assert one(spark, plural_lemma(F.col("w")), w="dogs") == "dogs"


def test_labels_are_made_once_however_often_they_are_used(spark):
    rows = [("/r/IsA", "/c/en/dogs", "/c/en/dog"), ("/r/IsA", "/c/en/hot_dog/n", "/c/en/food")]
    raw = spark.createDataFrame(rows, "relation string, start_uri string, end_uri string").repartition(2)
    kept = E.drop_same_stem(E.with_labels(raw))
    assert [(r["start"], r["end"]) for r in kept.collect()] == [("hot dog", "food")]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 4
