import os
import random
import re
from collections import defaultdict

import pytest

from ledgerloom.llm import minhash, shared
from ledgerloom.llm.minhash import banding, near_duplicates, op3_minhash_near_dedup

SF = "/root/testdata/sf0.01"


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op3_minhash_near_dedup(spark, SF)) == brute(rows)


def test_chains_short_texts_and_nulls(spark):
    base = [f"w{i}" for i in range(200)]
    chain = [" ".join(base[: 100 + 6 * k]) for k in range(12)]
    rows = list(enumerate(["", " \n", "One two", "one  TWO", "ÉCLAIR", "éclair", *chain, "x " * 5000]))
    docs = spark.createDataFrame([*rows, (900, None), (None, "one two")], "doc_id long, text string")
    out = near_duplicates(docs.selectExpr("*", "1 AS n", "2 AS node", "3 AS digest"))
    found = [tuple(r) for r in out.collect() if r["doc_id"] is None]
    assert found == [(None, 1, 2, False)]
    want = brute([*rows, (900, None)])
    assert {k: v for k, v in got(out).items() if k is not None} == want
    assert len({want[6 + k][1] for k in range(12)}) < 12


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similarity_of_80_is_the_default(spark):
    words = [f"w{i}" for i in range(104)]
    rows = [(k, " ".join(f"{k % 10}{w}" for w in words[: 104 if k < 10 else n])) for k, n in [*((k, 104) for k in range(10)), *((10 + k, 84 + k // 5) for k in range(10))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {len(shingles(t)) for _, t in rows}
    assert sizes == {100, 80, 81}
    assert sum(r["kept"] for r in near_duplicates(docs).collect()) == 10
    assert sum(r["kept"] for r in near_duplicates(docs, percent=85).collect()) == 20


def test_banding_follows_the_similarity():
    assert banding(85) == (26, 86)
    for percent in (50, 80, 85, 95):
        bands, least = banding(percent)
        assert (1 - (percent / 100) ** 5) ** bands <= 2.5e-7 and least < 5 * bands * percent / 100


def varied(seed, groups=12, each=10):
    """Texts in groups whose members lie at all similarities from each other."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(rng.choice([9, 40, 150]))]
        for _ in range(each):
            own = [w if rng.random() > rng.choice([0, 0.004, 0.01, 0.03, 0.06]) else f"x{rng.randrange(10**6)}" for w in base]
            rows.append((len(rows), " ".join(own[rng.choice([0, 0, 1, 4]) :])))
    return rows


@pytest.mark.parametrize("percent", [50, 65, 80, 95, 100])
def test_recall_at_other_similarities(spark, percent):
    rows = varied(percent)
    want = brute(rows, percent)
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)) == want
    assert len({w[1] for w in want.values()}) < len(rows)


@pytest.mark.parametrize("block", [1, 3, 50])
def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = varied(7, 4, 30)
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)) == brute(rows, 80)


def test_ids_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    rows = varied(3)
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)) == brute(rows, 80)


def test_repeated_ids_of_unlike_texts_and_a_very_long_text(spark):
    long = " ".join(f"w{k % 5000}x{k // 7}" for k in range(150_000))
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n"), (3, long), (4, long + " end")]
    found = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [r[0] for r in found] == [1, 1, 2, 3, 4]
    assert [r[2] for r in found] == [1, 1, 1, 3, 3]


def test_intermediate_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    out = near_duplicates(spark.createDataFrame(varied(5), "doc_id long, text string"))
    left = {x.rpartition("-")[0] for x in os.listdir(tmp_path)}
    assert left <= {"signatures", "classes", "nodes", "labels"} and out.count() == 120
