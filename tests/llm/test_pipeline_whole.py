"""The pipeline's stages at their own similarity, and on null and repeated ids."""

from collections import Counter, defaultdict

import corpus_pipeline

from tests.llm.test_minhash import shingles

SF = "/root/testdata/sf0.01"


def smallest_of_groups(rows, percent):
    """The ids that are the smallest of their group of near duplicates."""
    sets, by, root = {i: shingles(t) for i, t in rows}, defaultdict(list), {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j, both in Counter(j for x in sets[i] for j in by[x]).items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in sets[i]:
            by[x].append(i)
    return {i for i in sets if find(i) == i}


def test_near_dedup_takes_80_percent(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id").collect()}
    assert got == smallest_of_groups(rows, 80)
    assert len(got) < len(smallest_of_groups(rows, 85))
    print(len(rows), len(got), len(smallest_of_groups(rows, 85)))


def test_rows_go_by_themselves(spark):
    """Null and repeated ids: a rejected row takes no other row with it, and a group keeps one row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {r["text"] for r in docs.where("lang = 'en'").select("text").collect()}
    clean = docs.where("doc_id IS NOT NULL")
    for name, f in corpus_pipeline.STAGES[:4]:
        clean = f(spark, clean, SF).cache()
    a, b, c = [r["text"] for r in clean.where("lang = 'en' AND n_chars > 1500").orderBy("doc_id").limit(3).collect()]
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first()["text"]
    odd = [
        (None, a), (None, b), (None, ""), (None, None), (None, "12345 " * 60), (None, f"{c} {leak}"),
        (10**9, c), (10**9, b + " more"), (10**9, ""), (10**9 + 1, a), (10**9 + 1, c),
    ]
    assert {a, b, c} <= held
    rows = spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in odd], docs.schema)
    full = docs.where(~docs.text.isin(a, b, c)).union(rows)
    out = full
    for name, f in corpus_pipeline.STAGES[:4]:
        out = f(spark, out, SF).cache()
        assert out.columns == docs.columns
    got = {(r["doc_id"], r["text"]) for r in out.where("source = 'odd'").collect()}
    assert {i for i, t in got if t == a} == {10**9 + 1}
    assert {i for i, t in got if t.startswith(b)} == {10**9}
    assert {i for i, t in got if t == c} == {10**9}
    assert len(got) == 3


def test_null_ids_stay_where_their_text_is_unique(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(60)
    ids = docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars")
    rows = [(k, r["text"]) for k, r in enumerate(ids.collect())]
    got = [r["text"] for r in corpus_pipeline.near_dedup(spark, ids, SF).collect()]
    assert len(got) == len(smallest_of_groups(rows, 80))
