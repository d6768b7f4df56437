"""Rules that hold for any input; results against plain Python on small fixtures."""

import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.functions import knowledge_text as KT
from lorewell.functions.porter2 import stem
from lorewell.functions.text import STOP_WORDS
from lorewell.operators import edges as E
from lorewell.operators import knowledge as K
from lorewell.operators import terms as T
from lorewell.operators.ordered import dense_rank_by_digest, running, with_neighbour

quick = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
WORDS = ["dog", "cat", "hot", "related", "has", "is", "pet", "tail", "the", "of", "made", "x"]


def random_edges(spark, seed, n=400):
    rng = random.Random(seed)
    rows = {}
    for _ in range(n):
        # "dog" is a hub: a third of all edges start there
        start = "dog" if rng.random() < 0.34 else " ".join(rng.choices(WORDS, k=rng.choice([1, 2])))
        end = " ".join(rng.choices(WORDS, k=rng.choice([1, 2, 3])))
        rows[(start, end)] = f"/r/{rng.choice(['RelatedTo', 'HasA', 'IsA', 'MadeOf'])}"
    data = [(s, e, r, 1.0) for (s, e), r in rows.items()]
    return data, spark.createDataFrame(
        data, "start string, end string, relation string, weight double"
    )


def random_messages(spark, seed, n=30):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        parts = [rng.choice([*WORDS, ",", ".", "\n"]) for _ in range(rng.randint(0, 25))]
        texts.append(" ".join(parts))
    return texts, spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def phrase(relation):
    name = relation.removeprefix("/r/")
    return "".join(" " + c if c.isupper() else c for c in name).strip()


def brute_force(texts, edges, k):
    """The extraction by nested loops, one message after the other."""
    out = {}
    by_start = {}
    for s, e, r, _ in edges:
        by_start.setdefault(s, []).append((s, r, e))
    for mid, text in enumerate(texts):
        seen, found = set(), []
        pieces, cur = [], ""
        for ch in text + "\n":
            if ch in ".\n":
                pieces.append(cur)
                cur = ""
            else:
                cur += ch
        for piece in pieces:
            words = [w for w in piece.replace(",", " , ").split()]
            tf = Counter(w for w in words if w not in STOP_WORDS and w != ",")
            groups, group = [], []
            for w in [*words, ","]:
                if w in STOP_WORDS or w == ",":
                    if group:
                        groups.append(group)
                    group = []
                elif w not in seen:
                    seen.add(w)
                    group.append(w)
            for g in groups:
                bag = ([" ".join(g)] if len(g) > 1 else []) + g
                scored = []
                for term in bag:
                    for s, r, e in by_start.get(term, []):
                        tw = Counter(
                            w for w in f"{s} {phrase(r)} {e}".lower().split() if w not in STOP_WORDS
                        )
                        dot = sum(tf[w] * c for w, c in tw.items())
                        norm = sum(c * c for c in tf.values()) * sum(c * c for c in tw.values())
                        scored.append((-(dot / math.sqrt(norm) if norm else 0.0), s, r, e))
                found += [t[1:] for t in sorted(scored)[:k]]
        out[mid] = list(dict.fromkeys(found))
    return out


@pytest.mark.parametrize("limit", [None, 0, 5, 50])
def test_extraction_equals_nested_loops_at_any_hub_limit(spark, limit):
    data, edges = random_edges(spark, 3)
    texts, messages = random_messages(spark, 4)
    index = K.index_edges(edges, 3, limit)
    rows = K.extract_knowledge(messages, index, ["id"]).collect()
    got = {r["id"]: [tuple(t) for t in r["triples"]] for r in rows}
    assert got == brute_force(texts, data, 3)


@pytest.mark.parametrize("long_words", [0, 3])
def test_long_sentences_take_another_way_to_the_same(spark, long_words):
    data, edges = random_edges(spark, 11)
    texts, messages = random_messages(spark, 12)
    index = K.index_edges(edges, 3, 5)
    ranked = K.message_knowledge(messages, index, ["id"], long_words=long_words)
    rows = K.knowledge_arrays(ranked, ["id"]).collect()
    got = {r["id"]: [tuple(t) for t in r["triples"]] for r in rows}
    assert got == {i: t for i, t in brute_force(texts, data, 3).items() if t}


@pytest.mark.parametrize("long_words", [0, 4, 1000])
def test_context_equals_one_long_message(spark, long_words):
    data, edges = random_edges(spark, 13)
    texts, _ = random_messages(spark, 14, 12)
    turns = spark.createDataFrame(
        [(i // 4, i % 4, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string"
    )
    index = K.index_edges(edges, 3, 5)
    rows = K.context_knowledge(turns, index, long_words=long_words).collect()
    for conv in range(3):
        for turn in range(4):
            context = "\n".join(texts[conv * 4 : conv * 4 + turn + 1])
            known = {
                (r["start"], r["relation"], r["end"])
                for r in rows
                if r["conv_id"] == conv and r["turn"] <= turn
            }
            assert known == set(brute_force([context], data, 3)[0])


def test_extraction_without_broadcast(spark):
    data, edges = random_edges(spark, 5)
    texts, messages = random_messages(spark, 6)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = K.extract_knowledge(messages.repartition(3), K.index_edges(edges, 3, 5), ["id"])
        got = {r["id"]: [tuple(t) for t in r["triples"]] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == brute_force(texts, data, 3)


@pytest.mark.parametrize("long_words", [3, 1000])
def test_shuffled_hub_lookup_leaves_the_counts_behind(spark, long_words):
    data, edges = random_edges(spark, 41)
    texts, messages = random_messages(spark, 42)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = K.index_edges(edges, 3, 5)
        ranked = K.message_knowledge(messages, index, ["id"], long_words=long_words)
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        rows = K.knowledge_arrays(ranked, ["id"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # what a hub is asked, word by word, goes on without the sentence's counts
    probes = [x for x in plan.splitlines() if "Generate explode(map_keys(tf" in x]
    assert probes and all("), [] " not in x for x in probes)  # the exploded map is dropped at once
    got = {r["id"]: [tuple(t) for t in r["triples"]] for r in rows}
    assert got == {i: t for i, t in brute_force(texts, data, 3).items() if t}


def test_shuffled_lookup_takes_null_and_repeated_keys(spark):
    _, edges = random_edges(spark, 43)
    texts, _ = random_messages(spark, 44, 12)
    rows = [(None if i % 3 == 0 else i // 6, t) for i, t in enumerate([*texts, *texts])]
    messages = spark.createDataFrame(rows, "id long, text string")
    index = K.index_edges(edges, 3, 5)

    def found():
        return sorted(map(repr, K.message_knowledge(messages, index, ["id"]).collect()))

    broadcast = found()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found() == broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_built_index_gives_the_same(spark):
    _, edges = random_edges(spark, 7)
    _, messages = random_messages(spark, 8)
    plain = K.message_knowledge(messages, K.index_edges(edges, 2, None), ["id"])
    built = K.message_knowledge(messages, K.build_index(edges, 2, 3), ["id"])
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, built.collect()))


def test_token_table_and_row_local_terms_agree(spark):
    _, messages = random_messages(spark, 9, 60)
    local = T.sentence_terms(T.message_sentences(messages, ["id"]), ["id"])
    kept = T.first_mention(T.tokens(messages, ["id"]), ["id"], ["sent_no", "group_no", "pos"])
    named = kept.withColumn("term", F.col("surface"))
    table = T.group_terms(named, ["id", "sent_no", "group_no"])

    def bag(df):
        return Counter((r["id"], r["sent_no"], r["term"]) for r in df.collect())

    assert bag(local) == bag(table)


def test_sentence_counts(spark):
    _, messages = random_messages(spark, 10, 40)
    sents = T.message_sentences(messages, ["id"])
    words = {(r["id"], r["sent_no"]): Counter(r["words"]) for r in sents.collect()}
    for r in T.sentence_counts(sents).collect():
        expected = words[(r["id"], r["sent_no"])]
        assert r["tf"] == dict(expected)
        assert r["norm"] == sum(c * c for c in expected.values())


@quick
@given(st.lists(st.text(alphabet="ab ,|_é", min_size=1, max_size=6), max_size=4))
def test_cells_are_read_back(spark, items):
    ends = [i for i in items if i.strip()]
    rows = spark.createDataFrame([(ends,)], "ends array<string>").select(
        F.transform(
            "ends",
            lambda e: F.struct(F.lit("s").alias("start"), F.lit("/r/IsA").alias("relation"), e.alias("end")),
        ).alias("t")
    )
    got = rows.select(
        KT.parse_items(KT.render_enveloped("t")).alias("v2"),
        KT.parse_items(KT.render_list("t")).alias("v1"),
        F.transform(KT.parse_items(KT.render_list("t")), KT.unescape_separators).alias("plain"),
    ).first()
    assert len(got["v1"]) == len(got["v2"]) == len(ends)
    if not any("_" in e for e in ends):
        assert got["plain"] == [f"s Is A {e}" for e in ends]


@quick
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-5, 5)), min_size=1, max_size=25), st.integers(1, 7))
def test_running_values_do_not_depend_on_blocks(spark, values, block_rows):
    rows = [(g, i * 3, v) for i, (g, v) in enumerate(values)]
    df = spark.createDataFrame(rows, "g long, i long, v long")
    out = running(
        df, ["g"], "i", sums={"s": F.col("v")}, maxima={"m": F.col("v")}, block_rows=block_rows
    )
    got = {(r["g"], r["i"]): (r["s"], r["m"], r["is_last"]) for r in out.collect()}
    for g, i, _ in rows:
        before = [v for h, j, v in rows if h == g and j <= i]
        last = i == max(j for h, j, _ in rows if h == g)
        assert got[(g, i)] == (sum(before), max(before), last)


@quick
@given(st.sets(st.integers(0, 40), min_size=1), st.integers(1, 7), st.sampled_from([-1, 1]))
def test_neighbours_do_not_depend_on_blocks(spark, places, block_rows, step):
    df = spark.createDataFrame([("f", i, f"v{i}") for i in places], "f string, i long, v string")
    out = with_neighbour(df, ["f"], "i", {"near": "v"}, step, block_rows).collect()
    assert {r["i"]: r["near"] for r in out} == {
        i: f"v{i + step}" if i + step in places else None for i in places
    }


def test_digest_ranks_are_dense(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("d"))
    rows = dense_rank_by_digest(df, ["g"], "d", "no").collect()
    for g in (0, 1):
        mine = sorted((r["d"], r["no"]) for r in rows if r["g"] == g)
        assert [n for _, n in mine] == list(range(1, 151))


def test_collapse_leaves_one_row_per_pair(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.choice("cd"), f"/r/{i}", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "ord long, start string, end string, relation string, weight double")
    got = {(r["start"], r["end"]): r["relation"] for r in E.collapse_edges(df.repartition(4), "ord").collect()}
    assert got == {(s, e): r for _, s, e, r, _ in rows}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeiouyslngdt' ", max_size=12))
def test_stem_never_changes_the_first_letter(word):
    plain = word.removeprefix("'") if len(word) > 2 else word
    assert stem(word)[:1] == plain[:1]


def test_stem_filter_equals_direct_comparison(spark):
    rng = random.Random(2)
    pool = ["run", "running", "runs", "'run", "r", "dogs", "dog", "dog's", "die", "dying", "Dogs", "", "skies"]
    rows = [(rng.choice(pool), rng.choice(pool)) for _ in range(150)]
    df = spark.createDataFrame(rows, "start string, end string")
    got = Counter(tuple(r) for r in E.drop_same_stem(df).collect())
    assert got == Counter(r for r in rows if stem(r[0]) != stem(r[1]))
