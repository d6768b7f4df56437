"""The mixture's order holds its weights in every stretch."""

from collections import Counter
from fractions import Fraction

import pytest

from lorewell.operators import mixture as M


def mixed(spark, sizes, weights, total=None):
    rows = [(d, f"{d}{i}") for d, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame(rows, "dataset string, id string").repartition(5)
    out = M.mix_datasets(table, weights, seed=3, total=total, positions=True).collect()
    return sorted((r["position"], r["dataset"], r["id"], r["copy"]) for r in out)


@pytest.mark.parametrize("total", [None, 12_345])
def test_every_stretch_of_a_thousand_holds_the_weights(spark, total):
    sizes = {"bst": 400, "wow": 2500, "convai": 5000, "empathy": 1300}
    rows = mixed(spark, sizes, M.LARGE_MIXTURE, total)
    assert [r[0] for r in rows] == list(range(len(rows)))
    whole = sum(M.LARGE_MIXTURE.values())
    counts = Counter(d for _, d, *_ in rows[:1000])
    for i in range(len(rows) - 1000):
        for d, w in M.LARGE_MIXTURE.items():
            assert abs(counts[d] - 1000 * w / whole) <= 10
        counts[rows[i][1]] -= 1
        counts[rows[i + 1000][1]] += 1


def test_order_equals_sorting_by_exact_places(spark):
    sizes, weights = {"a": 3, "b": 7, "c": 11}, {"a": 2, "b": 5, "c": 1}
    rows = mixed(spark, sizes, weights, 40)
    quota = Counter(d for _, d, *_ in rows)
    seen, places = Counter(), []
    for _, d, *_ in rows:
        places.append((Fraction(2 * seen[d] + 1, 2 * quota[d]), d))
        seen[d] += 1
    assert places == sorted(places)


def test_order_and_draw_agree(spark):
    sizes, weights = {"a": 10, "b": 4}, {"a": 1, "b": 1}
    rows = mixed(spark, sizes, weights)
    plain = M.mix_datasets(
        spark.createDataFrame([(d, f"{d}{i}") for d, n in sizes.items() for i in range(n)], "dataset string, id string"),
        weights, seed=3,
    ).collect()
    assert Counter(r[1:] for r in rows) == Counter((r["dataset"], r["id"], r["copy"]) for r in plain)


def test_parts_follow_each_other(spark):
    rows = spark.range(1000).selectExpr("id AS position", "uuid() AS x")
    parts = M.training_order(rows.repartition(4), 6).rdd.glom().collect()
    flat = [r["position"] for part in parts for r in part]
    assert flat == list(range(1000)) and len(parts) == 6
