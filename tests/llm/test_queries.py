"""The registered queries against their SQL, and the pipeline, on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from veclode.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    mine = QUERIES[name](spark, DATA)
    cols = sorted(mine.columns)
    want = sql.sql(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, mine.select(*cols).collect())) == sorted(want)


def test_queries_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        assert docs.count() > 0.5 * n
    assert {"doc_id", "ids"} <= set(docs.columns)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0


def test_pipeline_run(spark):
    """run() gives the rows of its stages applied one after the other; only the last stage's folder stays."""
    import corpus_pipeline
    from veclode.llm.common import shared_dir

    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "sample", "ids", "decoded"} <= set(out.columns)
    rows = out.select("doc_id", "sample", "decoded").collect()
    assert rows and all(r["decoded"] for r in rows)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} <= set(docs)
    root = shared_dir(spark).removeprefix("file:")
    kept = [sorted(os.listdir(f"{root}/{x}")) for x in os.listdir(root) if x.startswith("pipeline-")]
    assert ["4"] in kept


def test_pipeline_of_awkward_rows(spark):
    """Nulls, repeats, ties and columns named like the stages' own: no stage fails, and columns keep their values."""
    import corpus_pipeline

    names = ["_q_score", "_k1", "_K2", "_dropped", "_row", "_text", "node", "score", "size", "finish", "pos"]
    words = [" ".join(f"{w}{i}" for w in ("the", "quick", "brown", "fox", "jumped", "over", "lazy", "dogs", "and", "ran") for i in range(k, k + 6)) + "." for k in range(30)]
    data = [(i, words[i], f"s{i % 3}") for i in range(30)] + [(40, words[3], None), (41, words[4] + " one more", "s1"), (3, words[3], "s0"), (None, words[5], "s0"), (42, None, "s1"), (43, "", None), (None, None, None)]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *(f"{n}{r[0]}" for n in names)) for r in data], schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA).cache()
        rows = docs.collect()
        if k < 4:
            assert docs.columns == [f.split(" ")[0] for f in schema.split(", ")]
            assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
        if k == 2:
            assert len([r for r in rows if r["text"] == words[3]]) <= 1 and len([r for r in rows if r["doc_id"] == 41]) == 0
    assert rows and all(r["decoded"] for r in rows)
