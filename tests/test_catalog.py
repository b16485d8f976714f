"""Every query of the catalog with SQL against DuckDB, and the entry module's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from veclode.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    mine = QUERIES[name](spark, DATA)
    cols = sorted(mine.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sql.sql(f"select {quoted} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, mine.select(*cols).collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["q_id", "rank", "id", "score"] and out.count() == 100  # ten for every 50th of 500 vectors
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def truth(spark):
    """The true ten nearest of every 50th vector, by brute force: of all vectors, and of those with an odd id."""
    from veclode.operators import search
    from veclode.plans import catalog

    base = catalog.embeddings(spark, DATA)
    of = lambda some: {(r["q_id"], r["id"]) for r in search.knn(some, catalog.queries_of(base), 10).collect()}
    return {"all": of(base), "odd": of(base.where("id % 2 = 1"))}


@pytest.mark.parametrize("name", ["a14_adc_scores", "i3_train", "i5_ivfpq_search", "i7_smart_search", "i8_residual_search", "i9_remove", "i10_rerank_search", "t13_distributed_cells"])
def test_index_has_recall(spark, truth, name):
    want = truth["odd" if name == "i9_remove" else "all"]
    mine = {(r["q_id"], r["id"]) for r in QUERIES[name](spark, DATA).collect()}
    print(name, len(want & mine) / len(want))
    assert {q for q, _ in mine} == {q for q, _ in want} and len(want & mine) >= 0.9 * len(want)
