"""Registered queries against their SQL twins at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from lorewell.plans import queries
from lorewell.plans.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def one_index(spark):
    """Build the edge index once for all queries here; `entry` builds its own."""
    built = queries.edge_index(spark, SF_DIR)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(queries, "edge_index", lambda *_: built)
        yield


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(ORACLES)
    assert set(queries.QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, db, one_index, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    left = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    sql = ORACLES[name]
    right = sorted(map(repr, db.execute(f"SELECT {quoted} FROM ({sql})").fetchall()))
    assert left == right and left
    assert sorted(d[0] for d in db.execute(sql + " LIMIT 0").description) == columns


def test_entry(spark):
    assert contract.entry(spark).count() > 0
