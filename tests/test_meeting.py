"""Mentions meet their edges after one shuffle."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lorewell.functions import vectors as V
from lorewell.operators import knowledge as K
from lorewell.operators import meeting as G

from .test_plans import plan


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def hub_edges(spark, n=40):
    rows = [("dog", "/r/IsA", f"w{i}") for i in range(n)] + [("cat", "/r/IsA", "a b"), ("cat", "/r/HasA", "b a")]
    return spark.createDataFrame(rows, "start string, relation string, end string")


def mentions(spark, n=300):
    """Most mentions name one start; keys stand there twice or are null."""
    rows = [
        (None if i % 50 == 0 else i // 2, "dog" if i % 3 else "cat", {"dog": 1, f"w{i % 40}": 1, "b": i % 4 + 1}, 20)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, term string, tf map<string,int>, norm long").withColumn(
        "group_no", F.lit(0).cast("bigint")
    )


@pytest.mark.parametrize("limit,share", [(5, 1.0), (100, 1.0), (5, 1e-9)])
def test_best_of_mentions_equals_ranking_all_candidates(spark, limit, share):
    index = K.index_edges(hub_edges(spark), 3, limit)
    terms = mentions(spark).withColumn("nth", F.monotonically_increasing_id())
    carried = ["id", "group_no", "nth"]
    got = G.best_of_mentions(terms, index.edges, carried, 3, share)
    every = K.sparse_scores(K.candidate_triples(terms, index.vectors))
    want = K.top_triples(every, ["nth"], 3).select(*carried, *K.TRIPLE, "score")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(got) == rows(want)
    assert got.count() == 200 * 3 + 100 * 2


def test_a_frequent_start_is_spread(spark):
    hot = G._spread_starts(mentions(spark), 1.0).collect()
    assert {r["hot"] for r in hot} == {"dog", "cat"} and min(r["pieces"] for r in hot) > 1


def test_lookup_in_a_large_index_shuffles_a_mention_once(spark, no_broadcast):
    index = K.index_edges(hub_edges(spark), 3, 5)
    terms = mentions(spark)
    text = plan(K.short_scores(terms, index, ["id"]))
    assert text.count("REPARTITION_BY_NUM") == 1 and "Join" not in text.split("MapInArrow")[0]
    assert "map_keys" not in text


def test_long_sentences_take_only_edges_of_their_terms(spark):
    index = K.index_edges(hub_edges(spark), 3, 5)
    terms = spark.createDataFrame([("cat",), (None,)], "term string")
    assert {r["start"] for r in K._mentioned(index, terms).vectors.collect()} == {"cat"}


def test_every_candidate_has_its_score_whatever_its_length(spark):
    """Short edges, long ones, and edges without words."""
    rows = [
        ("dog", "cat " * n + f"e{n}", "/r/IsA", ["dog"] + ["cat"] * n + [f"e{n}"], n * n + 2) for n in range(12)
    ]
    rows += [("dog", "none", "/r/IsA", [], 0), ("dog", "null", "/r/IsA", None, None)]
    edges = spark.createDataFrame(
        rows, "start string, end string, relation string, triple_words array<string>, triple_norm long"
    )
    terms = spark.createDataFrame(
        [(1, "dog", {"dog": 1, "cat": 2}, 5), (2, "dog", {}, 0)], "id long, term string, tf map<string,int>, norm long"
    )
    got = {(r["id"], r["end"]): r["score"] for r in K.sparse_scores(K.candidate_triples(terms, edges)).collect()}
    assert len(got) == 28
    for n in range(12):
        assert got[1, "cat " * n + f"e{n}"] == (1 + 2 * n) / math.sqrt(5 * (n * n + 2))
    assert got[1, "none"] == got[1, "null"] == got[2, "e0"] == 0.0


def test_rounding_equals_that_of_spark(spark):
    draw = random.Random(3)
    values = [draw.random() * 10 ** draw.randrange(-7, 13) * draw.choice([1, -1]) for _ in range(20000)]
    values += [i / 2e6 for i in range(-4000, 4000)] + [0.0, -0.0, 0.9999995, 1e300, float("inf"), None]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    other = table.filter(~V.rounded(F.col("x")).eqNullSafe(F.round("x", 6)))
    assert other.count() == 0


def hub_mentions(spark):
    """One start has nearly all candidates; rows stand there twice, terms are null."""
    rows = [
        (i // 2, None if i % 50 == 0 else "dog" if i % 3 else f"x{i}", {"dog": 1, f"w{i % 40}": 2, "b": 3}, 14)
        for i in range(600)
    ]
    return spark.createDataFrame(rows, "id long, term string, tf map<string,int>, norm long")


def test_candidates_of_a_hub_are_spread_over_the_parts(spark, tmp_path):
    for n in (40, 2000):  # more mentions than edges, and fewer
        terms, edges = hub_mentions(spark), hub_edges(spark, n)
        met = K.candidate_triples(terms, edges, K.spread_starts(terms, edges))
        columns = ["id", "term", "relation", "end"]
        rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
        assert rows(met) == rows(K.candidate_triples(terms, edges))
        sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < sum(sizes) / 8 and len(sizes) > 24


def all_scored(edges, tf, norm, k):
    """Every edge of the start that the index would let the mention meet, scored and sorted."""
    rows = []
    for e in edges:
        shared = [w for w in e["end_words"] if w in tf]
        if (shared[0] if shared else "") != e["word"]:
            continue
        product = norm * e["triple_norm"]
        score = sum(tf.get(w, 0) for w in e["triple_words"]) / math.sqrt(product) if product else 0.0
        place = (e["relation"] is not None, e["relation"] or "", e["end"] is not None, e["end"] or "")
        rows.append((-score, place, (e["relation"], e["end"])))
    return sorted(rows, key=lambda r: r[:2])[:k]


def test_edges_of_a_start_are_told_apart_by_words(monkeypatch):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    for trial in range(300):
        edges = []
        for i in range(draw.randrange(1, 30)):
            end = draw.sample(words, draw.randrange(0, 4))
            relation = draw.choice([None, "IsA", "w3 Of"])
            bag = draw.choice([["dog"], ["dog", "dog"], []]) * (trial % 3 > 0) + (relation or "").split() + end
            norm = sum(bag.count(w) ** 2 for w in set(bag))
            edge = {"relation": relation, "end": draw.choice([" ".join(end), None]), "triple_words": bag,
                    "triple_norm": norm, "end_words": end if trial % 2 else [], "word": ""}
            edges += [edge] + [edge | {"word": w} for w in edge["end_words"]] + [edge] * (trial % 7 == 0)
        start = G.StartEdges(edges)
        for _ in range(10):
            tf = {w: draw.randrange(1, 4) for w in draw.sample([*words, "dog"], draw.randrange(0, 6))}
            norm = sum(n * n for n in tf.values())
            want = all_scored(edges, tf, norm, 3)
            got = start.best(tf, norm, 3)
            assert [r[1:] for r in got] == [r[1:] for r in want]
            assert [r[0] for r in got] == pytest.approx([r[0] for r in want], abs=1e-12)


def test_a_mention_scores_few_edges_of_its_start(monkeypatch):
    """60 edges, one of them with a word of the sentence: it and the k first of the others are scored."""
    edges = [
        {"relation": "IsA", "end": f"e{i}", "triple_words": ["dog", "IsA", f"e{i}"], "triple_norm": 3,
         "end_words": [], "word": ""} for i in range(60)
    ]
    start, scored = G.StartEdges(edges), []
    one = G._scored
    monkeypatch.setattr(G, "_scored", lambda *x: scored.append(x) or one(*x))
    got = start.best({"dog": 1, "e50": 1, "other": 2}, 6, 3)
    assert [r[2][1] for r in got] == ["e50", "e0", "e1"] and len(scored) == 4


def filters(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in text.splitlines() if "Filter" in x or "DataFilters" in x]


def test_no_filter_makes_the_counts_of_sentences(spark, no_broadcast):
    index = K.index_edges(hub_edges(spark), 3, 5)
    turns = spark.createDataFrame([(1, 0, "a dog. w1 dog"), (1, 1, "cat b")], "conv_id long, turn long, text string")
    for ranked in (K.context_knowledge(turns, index), K.message_knowledge(turns, index, ["conv_id", "turn"])):
        assert not [x for x in filters(ranked) if "map_from_arrays" in x]
        assert ranked.count() > 0


def test_found_triples_go_to_their_message_once(spark, no_broadcast):
    index = K.index_edges(hub_edges(spark), 3, 5)
    turns = spark.createDataFrame([(1, 0, "a dog. w1 dog")], "conv_id long, turn long, text string")
    keys = ["conv_id", "turn"]
    ranked = K.message_knowledge(turns, index, keys)
    text = plan(K.distinct_triples(ranked.filter("start <> 'x'"), keys))
    # the tree, from the result down to the lookup
    assert text[: text.index("MapInArrow")].count("- Exchange (") == 1
