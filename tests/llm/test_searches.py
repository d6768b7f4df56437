"""Vector searches and URL filters against brute force."""

import random

import numpy as np
import pytest

from lorewell.llm import impact_search, learned_partitions, vectors
from lorewell.llm.url_filter import OP7_SQL, absolute, filter_urls, node_of
from lorewell.llm.vectors import usable_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, part int, vec string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def hard(spark):
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(8)]) for i in range(600)]
    rows += [(1000 + i, rows[50][1]) for i in range(300)]  # one common vector
    rows += [(50, rows[50][1]), (None, rows[1][1]), (2000, None), (2050, []), (2100, [0.0] * 8),
             (2150, [1.0, None] + [0.0] * 6), (2200, [float("nan")] * 8), (2250, [float("inf")] * 8),
             (2300, [1.0, 2.0])]
    return frame(spark, rows)


def usable(rows, zero):
    out = []
    for r in rows:
        v = r.embedding
        if r.vec_id is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        if zero or any(v):
            out.append((r.vec_id, np.array(v, float)))
    return out


@pytest.mark.parametrize("levels, few", [(16, 256), (4, 3)])
def test_exact_top_k(spark, hard, monkeypatch, levels, few):
    monkeypatch.setattr(impact_search, "BLOCK", 100)
    rows = vectors_of(hard)
    queries = rows.filter("vec_id % 50 = 0")
    got = {}
    for r in impact_search.exact_top_k(rows, queries, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ours = [(i, np.floor(256 * v).astype(np.int64)) for i, v in usable(hard.collect(), True)]
    for name, q in ours:
        if name % 50 == 0:
            best = sorted((-int(v @ q), i) for i, v in ours if i != name and len(v) == len(q))[:5]
            wanted = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
            # A repeated query row is answered twice.
            assert sorted(set(got.get(name, []))) == wanted
    assert impact_search.exact_top_k(rows.filter("vec_id < 0"), queries, 5).count() == 0


def test_blocks_of_queries_never_travel_through_the_driver(spark, hard, monkeypatch):
    """Their files are small, their copies for all parts are not: no broadcast may hold them."""
    monkeypatch.setattr(impact_search, "BLOCK", 10)
    rows = vectors_of(hard)
    plan = impact_search.exact_top_k(rows, rows.filter("vec_id % 50 = 0"), 5)._jdf.queryExecution().executedPlan()
    assert "Broadcast" not in plan.toString()


def test_a_block_of_rows_is_copied_for_a_bounded_number_of_tasks(spark, hard):
    rows = vectors_of(hard).select(impact_search.F.lit(0).alias("part"), "vec_id", "vec")
    index = vectors.blocks(rows.coalesce(1), "<i8", 1000)
    asking = vectors.numbered_queries(rows.repartition(60), "<i8")
    blocks, asked = index.count(), asking.count()
    met = impact_search.met_blocks(index, asking, 1, 60).collect()
    listed = [r.piece for r in met if r.q_block is None]
    assert len(set(listed)) == 4 * 8 and len(listed) == 4 * 8 * blocks
    assert sorted(r.q_block for r in met if r.q_block is not None) == sorted(r.q_block for r in asking.collect())
    assert asked > 4 * 8


def test_exact_top_k_equals_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    there = db.execute(f"SELECT query_id, rank, vec_id, score FROM ({impact_search.OP6_SQL})").fetchall()
    got = impact_search.op6_exact_top_k(spark, folder).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(there) == sorted(map(tuple, got)) and there


def vectors_of(frame_):
    F = impact_search.F
    whole = F.transform("vec", lambda x: F.floor(x * 256).cast("bigint"))
    return impact_search.written(usable_vectors(frame_).select("vec_id", whole.alias("vec")), "v")


def test_index_proves_its_candidates():
    random_ = np.random.default_rng(4)
    values = random_.integers(-90, 90, (2000, 16))
    index = impact_search.ImpactIndex(values)
    for i in range(20):
        query = values[i] + random_.integers(-5, 5, 16)
        rows = index.top(query, 5, np.array([i]))
        exact = values @ query
        exact[i] = -(10**9)
        assert set(np.lexsort((np.arange(2000), -exact))[:5]) <= set(rows.tolist())
        assert i not in rows


def test_nearest_neighbours(spark, hard, monkeypatch):
    monkeypatch.setattr(learned_partitions, "ROWS_PER_PART", 128)
    monkeypatch.setattr(learned_partitions, "BLOCK", 64)
    rows = learned_partitions.written(usable_vectors(hard, zero=False), "v")
    out = learned_partitions.nearest(rows, rows.filter("vec_id % 100 = 0"), 10).collect()
    ours = [(i, v) for i, v in usable(hard.collect(), False) if len(v) == 8]
    assert not [r for r in out if r.query_id in (2300,)]  # nothing else is as short as its vector
    hits = total = 0
    for name, q in ours:
        if name % 100 == 0:
            best = sorted((float(np.sqrt(((v - q) ** 2).sum())), i) for i, v in ours if i != name)[:10]
            mine = sorted((r["rank"], r.score, r.vec_id) for r in out if r.query_id == name)
            assert [r for r, _, _ in mine] == list(range(1, 11))
            assert [x[1:] for x in mine] == sorted(x[1:] for x in mine)
            distance = {i: float(np.sqrt(((v - q) ** 2).sum())) for i, v in ours}
            assert all(s == pytest.approx(distance[i], rel=1e-12, abs=1e-12) for _, s, i in mine)
            hits += len({i for _, i in best} & {i for _, _, i in mine})
            total += 10
    assert hits >= 0.9 * total
    assert learned_partitions.nearest(rows.filter("vec_id < 0"), rows.filter("vec_id < 0")).count() == 0


def test_repeated_queries_and_other_lengths(spark, monkeypatch):
    """Half of the vectors are of another length, a few of a third; a query row stands there three times."""
    monkeypatch.setattr(learned_partitions, "ROWS_PER_PART", 64)
    draw = random.Random(6)
    width = lambda i: 3 if i % 40 == 0 else 8 if i % 2 else 5
    rows = [(i, [draw.gauss(0, 1) for _ in range(width(i))]) for i in range(800)]
    rows += [rows[200]] * 2 + [rows[101]] * 2
    table = learned_partitions.written(usable_vectors(frame(spark, rows), zero=False), "v")
    assert len(learned_partitions._learn(table).routers) == 2
    got = learned_partitions.nearest(table, table.filter("vec_id in (0, 101, 200, 202)"), 10).collect()
    times = {0: 1, 101: 3, 200: 3, 202: 1}
    for name, n in times.items():
        q = np.array(rows[name][1])
        ours = sorted((float(np.sqrt(((np.array(v) - q) ** 2).sum())), i) for i, v in rows if i != name and len(v) == len(q))
        mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == name)
        assert [r for r, _ in mine] == [r for r in range(1, 11) for _ in range(n)]
        hits = {i for _, i in ours[:10]} & {i for _, i in mine}
        assert len(hits) == 10 if name in (0, 200) else len(hits) >= 8


def test_parts_are_balanced():
    x = np.random.default_rng(2).normal(size=(1000, 8))
    part = learned_partitions.balanced_parts(x, learned_partitions.neighbour_graph(x), 7)
    assert np.bincount(part, minlength=7).max() <= learned_partitions.SLACK * 1000 / 7 + 1


PAGES = [
    (1, "https://a.org/x", '<link rel="canonical" href="https://b.net/fr/1">'),
    (2, "http://c.org/", '<META content="0; url=http://a.org/x#t" http-equiv=Refresh>'),
    (3, "http://d.org", "<link href=/q rel=canonical>"),
    (4, "http://e.org/q?z", '<link rel=canonical href="http://www.Example.com/en/2">'),
    (5, "http://f.net/es/", '<link rel=canonical href="//e.org/q?z">'),
    (6, None, None),
    (7, "nope", '<link rel=canonical href="http://b.net/fr/1">'),
    (8, "http://EXAMPLE.com/en/1?x", "<link rel=stylesheet href=http://a.org/x>"),
    (9, "http://www.example.com/en/", ""),
    (10, "http://com", None),
    (10, "http://com", None),
    (None, "ftp://xcom/://net/es/", None),
]


def test_url_filter(spark):
    pages = spark.createDataFrame([(*p, "h", "r") for p in PAGES], "page_id bigint, url string, html string, host string, node string")
    got = sorted(map(tuple, filter_urls(pages).collect()), key=repr)
    wanted = [
        (1, "a.org", "/x", None, "block"), (2, "c.org", "/", None, "block"), (3, "d.org", "", None, "allow"),
        (4, "e.org", "/q", None, "allow"), (5, "f.net", "/es/", "net/es/", "block"), (6, "", "", None, "allow"),
        (7, "", "", None, "allow"), (8, "example.com", "/en/1", "example.com/en/", "block"),
        (9, "www.example.com", "/en/", "www.example.com/en/", "allow"), (10, "com", "", None, "allow"),
        (10, "com", "", None, "allow"), (None, "xcom", "/://net/es/", None, "allow"),
    ]
    assert got == sorted(wanted, key=repr)
    assert filter_urls(pages.filter("page_id < 0")).count() == 0


@pytest.mark.parametrize("target, wanted", [
    ("/q", "a.org/q"), ("q", "a.org/x/q"), ("//B.org", "b.org/"), ("?k", "a.org/x/y?k"),
    ("#f", "a.org/x/y"), ("http://c.org/z#f", "c.org/z"),
])
def test_targets_are_resolved(spark, target, wanted):
    F = impact_search.F
    row = spark.range(1).select(node_of(absolute(F.lit(target), F.lit("https://A.org/x/y?z#f"))).alias("n"))
    assert row.first().n == wanted


def test_url_filter_equals_its_sql(spark):
    import duckdb
    import pandas as pd

    schema = "page_id bigint, url string, html string"
    got = filter_urls(spark.createDataFrame(PAGES, schema)).collect()
    db = duckdb.connect()
    pages = pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    db.register("pages", pages)
    there = db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({OP7_SQL})").fetchall()
    assert sorted(map(repr, there)) == sorted(repr(tuple(r)) for r in got)
