"""Keyed tables: what a merge touches, and what merging again does."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom import jobs
from ledgerloom.operators import graph
from ledgerloom.shared import Table
from ledgerloom.sources import sinks


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def writes(spark, rows):
    return spark.createDataFrame(rows, "node_id string, label string, a string, b int, seq long")


def held(store):
    return {r["node_id"]: (r["a"], r["b"]) for r in store.nodes().collect()}


def test_one_row_rewrites_one_bucket(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), buckets=8)
    last = lambda both: graph.replace_rows(both, ["k"], "at")
    t.merge(spark.range(400).selectExpr("id AS k", "'old' AS v", "0 AS at"), ["k"], last)
    before = files(tmp_path / "t")
    assert len({p.split("_bucket=")[1][0] for p in before}) == 8
    t.merge(spark.sql("SELECT 7L AS k, 'new' AS v, 1 AS at"), ["k"], last)
    new = {p for p in files(tmp_path / "t") if p not in before}
    assert len({os.path.dirname(p) for p in new}) == 1
    rows = {r["k"]: r["v"] for r in t.read().collect()}
    assert len(rows) == 400 and [k for k, v in rows.items() if v == "new"] == [7]
    assert t.read(1).where("v = 'new'").count() == 0
    t.merge(spark.sql("SELECT 7L AS k, 'late' AS v, 0 AS at"), ["k"], last)
    assert t.versions() == [2, 3] and t.read().where("k = 7").first()["v"] == "new" and t.read().count() == 400
    left = {d for d in os.listdir(tmp_path / "t") if d.startswith("d=")}
    assert left == {"d=1", "d=2", "d=3"} and len(os.listdir(tmp_path / "t" / "d=1")) < 2 * 8 + 2


def test_the_number_of_buckets_stays_as_it_was_dealt(spark, tmp_path):
    last = lambda both: graph.replace_rows(both, ["k"], "at")
    rows = lambda at: spark.range(60).selectExpr("id AS k", f"{at} AS at")
    Table(spark, str(tmp_path / "t"), buckets=5).merge(rows(1), ["k"], last)
    other = Table(spark, str(tmp_path / "t"), buckets=9)
    assert sorted(tuple(r) for r in other.merge(rows(2).where("k < 30"), ["k"], last).collect()) == [(k, 2 if k < 30 else 1) for k in range(60)]
    one = spark.range(1).select(other.bucket(F.lit(7).cast("long"))).first()[0]
    assert other.read(buckets=[one]).where("k = 7").count() == 1


def test_a_merge_that_failed_is_not_read(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    once = lambda both: both.distinct()
    t.merge(spark.range(5), ["id"], once)
    os.makedirs(tmp_path / "t" / "d=2")  # written, but not yet shown
    with pytest.raises(Exception):
        t.merge(spark.range(9), ["id"], lambda both: both.select(F.raise_error(F.lit("stopped")).cast("long").alias("id")))
    assert t.read().count() == 5 and t.merge(spark.range(9), ["id"], once).count() == 9
    assert t.merge(spark.range(0), ["id"], once).count() == 9


def test_whole_tables_new_columns_and_empty_ones(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    assert t.read() is None and t.merge(spark.range(0), ["id"], lambda both: both).count() == 0
    t.write(spark.range(6))
    rows = t.merge(spark.sql("SELECT 2L AS id, 'x' AS more"), ["id"], lambda both: both.groupBy("id").agg(F.max("more").alias("more")))
    assert sorted((r["id"], r["more"]) for r in rows.collect()) == [(k, "x" if k == 2 else None) for k in range(6)]


def test_replayed_and_late_batches_change_nothing(spark, tmp_path):
    store = sinks.GraphStore(spark, str(tmp_path / "g"))
    assert store.nodes() is None and store.edges() is None
    first, second = [("n", "Company", "one", 1, 1), ("m", "Company", None, None, 1)], [("n", "Company", "five", None, 5)]
    for rows in (second, first, second, first):
        store.upsert_nodes(writes(spark, rows))
    assert held(store) == {"n": ("five", 1), "m": (None, None)}
    # the property set by 1 gives way to 3, the one set by 5 does not
    store.upsert_nodes(writes(spark, [("n", "Company", "three", 3, 3)]))
    assert held(store)["n"] == ("five", 3) and store.nodes().columns == ["label", "node_id", "a", "b"]
    store.upsert_nodes(writes(spark, [("n", "Company", "no sequence", 9, None), ("o", "Company", "none", 2, None)]))
    assert held(store) == {"n": ("five", 3), "m": (None, None), "o": ("none", 2)}


def test_edges_need_nodes_and_the_last_write_counts(spark, tmp_path):
    store = sinks.GraphStore(spark, str(tmp_path / "g"))
    edge = lambda ref, seq, to="c": spark.createDataFrame([("n", "COMPETES_WITH", to, ref, seq)], "subject_id string, relation_type string, object_id string, filing_ref string, seq long")
    assert store.upsert_edges(edge("f1", 1)).count() == 0
    store.upsert_nodes(writes(spark, [("n", "Company", "x", 1, 1), ("c", "Competitor", "y", 1, 1)]))
    for ref, seq in (("f5", 5), ("f1", 1), ("f5", 5)):
        store.upsert_edges(edge(ref, seq).unionByName(edge(ref, seq, "nobody")))
    rows = [tuple(r) for r in store.edges().select("subject_id", "object_id", "filing_ref", "filing_refs").collect()]
    assert rows == [("n", "c", "f5", ["f1", "f5"])]


def test_nodes_and_edges_are_shown_together(spark, tmp_path, monkeypatch):
    store = sinks.GraphStore(spark, str(tmp_path / "g"))
    nodes = writes(spark, [("n", "Company", "x", 1, 1), ("c", "Competitor", "y", 1, 1)])
    edges = spark.createDataFrame([("n", "COMPETES_WITH", "c", "f", 1)], "subject_id string, relation_type string, object_id string, filing_ref string, seq long")
    monkeypatch.setattr(sinks.GraphStore, "_put_edges", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.write_documents(nodes, edges)
    assert store.nodes() is None
    monkeypatch.undo()
    whole, links = store.write_documents(nodes, edges)
    assert whole.where("label <> 'FiscalYear'").count() == 2 and links.where("relation_type = 'COMPETES_WITH'").count() == 1
    cleaned, _ = store.replace(whole.where("node_id <> 'c'"), links.where("false"))
    assert cleaned.where("node_id = 'c'").count() == 0 and store.edges().count() == 0
    store.upsert_nodes(writes(spark, [("n", "Company", "older", 0, 0)]))
    assert held(store)["n"] == ("x", 1)


def test_events_of_all_tables_once(spark, tmp_path):
    head = "cik,company,date,accession,item_name\n"
    row = "42,X,2020-02-01,00-1,5.02 Departure\n"
    (tmp_path / "a.csv").write_text(head + row + row + "7,Y,2021-03-01,00-2,1.01 Deal\n")
    (tmp_path / "b.csv").write_text(head + row)
    (tmp_path / "c.csv").write_text("nothing,here\n1,2\n")
    companies = spark.createDataFrame([("42",)], "cik string")
    for _ in range(2):
        nodes = jobs.ingest_8k_events(spark, [str(tmp_path / f"{x}.csv") for x in "abc"], str(tmp_path / "g"), companies)
        assert nodes.count() == 2
    edges = sinks.GraphStore(spark, str(tmp_path / "g")).edges()
    assert sorted(r["relation_type"] for r in edges.collect()) == ["FILED_IN", "FILED_IN", "HAS_8K_EVENT"]


def test_rows_by_sequence_and_one_key(spark, tmp_path):
    index = sinks.Index(spark, str(tmp_path / "i"))
    row = lambda name, seq: spark.createDataFrame([("1", name, seq)], "cik string, name string, at long")
    for name, seq in (("new", 5), ("old", 1)):
        index.replace_rows("companies", row(name, seq), "at")
    assert [tuple(r) for r in index.read("companies").collect()] == [("1", "new")]
    assert index.find("companies", "1").first()["name"] == "new" and index.find("companies", "2").count() == 0 and index.find("deltas", "x") is None
