"""The approximate index against exact search."""

import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.operators import ann, vectors
from ledgerloom.plans.catalog import QUERIES


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_against_exact_search(spark, folder):
    near = {(r["query"], r["vec_id"]) for r in QUERIES["vector_ann"](spark, folder).collect()}
    exact = {(r["query"], r["vec_id"]) for r in QUERIES["vector_topk"](spark, folder).collect()}
    assert len(near) == len(exact) and len(near & exact) >= 0.95 * len(exact)


def test_recall_where_vectors_gather(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 16))[rng.integers(40, size=1500)] + 0.25 * rng.normal(size=(1500, 16))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "k long, v array<double>").cache()
    q = df.where("k % 20 = 0")
    near = {(r[0], r[1]) for r in ann.Index(spark, str(tmp_path / "i")).build(df, "k", "v").search(q, "k", "v", 10, share=0.1).collect()}
    exact = {(r[0], r[1]) for r in vectors.search(df, q, "k", "v", 10).collect()}
    assert len(near & exact) >= 0.95 * len(exact) and len(exact) == 750


def test_all_lists_and_candidates_are_exact_search_in_any_blocks(spark, tmp_path, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.where("vec_id < 30")
    index = ann.Index(spark, str(tmp_path / "i")).build(e, "vec_id", "embedding", 9)
    want = [tuple(r) for r in vectors.search(e, q, "vec_id", "embedding", 5).orderBy("query", "rank").collect()]
    monkeypatch.setattr(ann, "ROWS", 20)
    monkeypatch.setattr(ann, "QUERIES", 4)
    found = index.search(q, "vec_id", "embedding", 5, share=1.0, exact=200).orderBy("query", "rank")
    assert [tuple(r) for r in found.collect()] == want and len(want) == 150


def test_one_query_reads_its_lists_only(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = ann.Index(spark, str(tmp_path / "i")).build(e, "vec_id", "embedding", 20)
    rows = index.table.read()
    assert rows.count() == 500 and rows.select("list").distinct().count() == 20
    some = index.search(e.where("vec_id = 40"), "vec_id", "embedding", 3, share=0.05)
    of = {r["vec_id"]: r["list"] for r in rows.withColumnRenamed("id", "vec_id").select("vec_id", "list").collect()}
    assert {of[r["id"]] for r in some.collect()} == {of[40]}


def test_vectors_that_cant_be_indexed(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 2.0, 3.0]), (5, [0.6, 0.8]), (6, [1.0, None]), (None, [1.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, vec array<double>").selectExpr("*", "1 AS list", "2 AS id", "3 AS codes")
    index = ann.Index(spark, str(tmp_path / "i")).build(df, "k", "vec")
    found = index.search(df, "k", "vec", 2, share=1.0).orderBy("query", "rank")
    assert [tuple(r) for r in found.collect()] == [(1, 1, 1.0, 1), (1, 7, 1.0, 2), (5, 5, 1.0, 1), (5, 1, 0.6, 2), (7, 1, 1.0, 1), (7, 7, 1.0, 2)]
    empty = ann.Index(spark, str(tmp_path / "e")).build(df.where("false"), "k", "vec")
    assert empty.search(df, "k", "vec", 2).count() == 0


def test_unit_of_sliced_columns():
    column = pa.array([[3.0, 4.0], None, [0.0, 0.0], [1.0], [0.0, 2.0], [None, 1.0]], pa.list_(pa.float64()))
    got = vectors.unit(column.slice(1), 2)
    assert np.isnan(got[[0, 1, 2, 4]]).any(axis=1).all() and got[3].tolist() == [0, 1]
    assert vectors.unit(column, 2)[0].tolist() == [0.6, 0.8]


def test_lists_are_put_together_so_that_candidates_dont_grow_with_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 30)
    assert ann.grouped([10, 20, 1, 0, 70, 5, 5]) == ([2, 4, 5, 7], [1, 1, 3, 1])
    monkeypatch.undo()
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = ann.Index(spark, str(tmp_path / "i")).build(e, "vec_id", "embedding", 50)
    found = index.search(e.where("vec_id < 20"), "vec_id", "embedding", 1, share=1.0, exact=1)
    # a row a query from the one group of 50 lists, not one from each list
    kept = found._jdf.queryExecution().toString()
    assert found.count() == 20 and re.search(r"CoGroup\w* \[g#\d+, i#\d+, j#\d+\]", kept)
