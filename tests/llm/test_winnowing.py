import hashlib
import re

import duckdb
import pytest

from ledgerloom.llm import winnowing

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, its = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if x := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    its |= x
        names = sorted(str(i) for i in its if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.drop("item_ids").collect()), key=str)


def test_query(spark):
    tables = [[tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))]
    want = brute(*tables)
    assert sum(r[-1] for r in want) > 5
    assert got(winnowing.op7_winnowing_decontamination(spark, SF)) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet{'' if t == 'benchmark' else ''}')")
    cols = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    assert sorted(con.execute(f"SELECT {cols} FROM ({winnowing.OP7_SQL})").fetchall(), key=str) == want


@pytest.mark.parametrize("most", [0, 200_000])
def test_short_items_nulls_and_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", most)
    a = " ".join(f"w{i}" for i in range(30))
    items = [(1, a), (2, "Alpha  beta"), (3, ""), (4, None), (5, "É é"), (6, " ".join(["x"] * 12)), (7, a), (None, "only null"), (10, "alpha beta")]
    docs = [(1, "zz " + a[10:80] + " alpha-BETA gamma"), (2, None), (3, ""), (4, "x " * 40), (5, "É É é"), (6, "w0 w1 w2"), (None, a), (8, a), (8, a), (8, "alpha beta"), (9, "only, null")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS w")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS key", "2 AS doc_id")
    assert got(winnowing.contamination(d, i)) == brute(docs, items)
    assert got(winnowing.contamination(d, i.where("item_id = 1"))) == brute(docs, items[:1])
    assert got(winnowing.contamination(d, i.where("false"))) == brute(docs, [])
    assert winnowing.contamination(d.where("false"), i).count() == 0
