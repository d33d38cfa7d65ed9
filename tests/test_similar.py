"""The set-similarity join against all pairs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import similar


def brute(rows, percent):
    sets = defaultdict(list)
    for owner, period, key, words in rows:
        if owner is not None and period is not None and words:
            sets[owner, period, frozenset(words)].append(key)
    out = []
    for (o, p, x), keys in sets.items():
        for (o2, p2, y), later in sets.items():
            both = len(x & y)
            if o == o2 and p2 == p + 1 and 100 * both >= percent * len(x | y):
                out.append((o, p2, min(keys), min(later), len(keys), len(later), both))
    return sorted(out)


def classes(spark, rows):
    df = spark.createDataFrame(rows, "o string, y int, k long, w array<string>").selectExpr("*", "1 AS c", "2 AS n", "3 AS owner", "4 AS word")
    return similar.classes(df, "o", "y", "k", F.array_distinct("w"))


def got(found):
    return sorted(tuple(r) for r in found.select("owner", "period", "key_a", "key_b", "copies_a", "copies_b", "shared").collect())


@pytest.mark.parametrize("percent", [30, 50, 80, 100])
def test_against_all_pairs(spark, percent):
    rng, rows = random.Random(percent), []
    bases = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 3, 8, 20]))] for _ in range(9)]
    for k in range(220):
        base = rng.choice(bases)
        words = [w if rng.random() > rng.choice([0, 0, 0.1, 0.4]) else f"x{rng.randrange(30)}" for w in base]
        rows.append((rng.choice("ab"), rng.randrange(4), k, words))
    found = got(similar.links(classes(spark, rows), percent))
    assert found == brute(rows, percent) and found


def test_copies_nulls_and_empty_sets(spark):
    rows = [("a", 1, k, ["x", "y", "z"]) for k in range(40)] + [("a", 2, 100 + k, ["z", "y", "x", "x"]) for k in range(30)]
    rows += [("a", 2, 7, []), ("a", 2, 8, None), (None, 1, 9, ["x"]), ("a", None, 10, ["x"]), ("a", 4, 11, ["x", "y", "z"]), ("b", 2, 12, ["x", "y", "z"])]
    sets = classes(spark, rows)
    found = similar.links(sets)
    assert got(found) == [("a", 2, 0, 100, 40, 30, 3)]
    assert sorted((r["owner"], r["period"], r["key"], r["link"]) for r in similar.evolution(sets, found).collect()) == [
        ("a", 1, 0, "EMERGED_IN"), ("a", 2, 100, "PERSISTED_TO"), ("a", 3, 100, "RESOLVED_IN"), ("a", 4, 11, "EMERGED_IN"), ("b", 2, 12, "EMERGED_IN"),
    ]


def test_nothing(spark):
    sets = classes(spark, [])
    found = similar.links(sets)
    assert found.count() == 0 and similar.evolution(sets, found).count() == 0


def test_sets_move_to_their_links_only_where_they_met(spark, monkeypatch):
    staged = {}
    monkeypatch.setattr(similar, "stage", lambda df, tag, f=similar.stage: staged.setdefault(tag, f(df, tag)))
    rows = [(k, "x", k // 10, " ".join(f"w{k}_{i}" for i in range(9))) for k in range(18)] + [(18, "x", 1, " ".join(f"w0_{i}" for i in range(9)))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, period long, text string")
    found = similar.links(similar.classes(docs, "lang", "period", "doc_id", similar.word_set(F.col("text"))))
    assert [(r["key_a"], r["key_b"], r["shared"]) for r in found.collect()] == [(0, 18, 9)]
    assert staged["sets"].count() == 2 and staged["prefixes"].count() == 19 * 2
