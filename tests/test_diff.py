"""The diff by joins and rounds against the standard library's matcher."""

import random

from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions import text
from ledgerloom.operators import diff
from tests.brute_diff import block_rows

PAIR = "i long, n string, previous array<string>, latest array<string>"


def check(spark, pairs):
    df = spark.createDataFrame([(k, f"p{k % 3}", a, b) for k, (a, b) in enumerate(pairs)], PAIR)
    got = diff.blocks(df.repartition(3), "i", "n").collect()
    want = {(k, f"p{k % 3}", x, *row) for k, (a, b) in enumerate(pairs) for x, row in enumerate(block_rows(a or [], b or []))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_random_pairs_of_few_and_many_words(spark):
    rng = random.Random(4)
    pairs = []
    for words in (1, 2, 3, 5, 12, 60):
        for _ in range(25):
            a = [f"w{rng.randrange(words)}" for _ in range(rng.randrange(24))]
            b = [f"w{rng.randrange(words)}" for _ in range(rng.randrange(24))]
            pairs.append((a, b))
    check(spark, pairs)


def test_edited_texts(spark):
    rng, pairs = random.Random(5), []
    for _ in range(20):
        a = [f"line {rng.randrange(150)}" for _ in range(rng.randrange(200))]
        b = list(a)
        for _ in range(rng.randrange(25)):
            at, kind = rng.randrange(len(b) + 1), rng.randrange(3)
            if kind == 0:
                b.insert(at, f"new {rng.randrange(40)}")
            elif kind == 1:
                del b[at : at + rng.randrange(6)]
            else:
                cut = b[at : at + 8]
                del b[at : at + 8]
                b += cut
        pairs.append((a, b))
    check(spark, pairs)


def test_empty_null_and_repeated(spark):
    check(spark, [(None, ["a"]), (["a"], None), (None, None), ([], []), ([""], [""]), (["a", None, "b"], ["a", None, "c"]), (["x"] * 40, ["x"] * 33)])
    df = spark.createDataFrame([(1, "k", ["a"], ["a"]), (1, "k", ["a"], ["a"]), (None, "k", ["a"], ["b"])], PAIR)
    assert [tuple(r) for r in diff.blocks(df, "i", "n").collect()] == [(1, "k", 0, "context", "a", None)]
    assert diff.blocks(df.where("false"), "i", "n").count() == 0


def test_runs_that_nothing_crosses_take_one_round(spark, monkeypatch):
    """Every second line changed: as many runs as lines are kept, in one round."""
    rounds = []
    plain = diff._parted
    monkeypatch.setattr(diff, "_parted", lambda *given: rounds.append(1) or plain(*given))
    check(spark, [([f"{k}" for k in range(400)], [f"{k}{'x' * (k % 2)}" for k in range(400)])])
    assert len(rounds) == 2


def test_lines_stay_in_the_row_of_their_pair(spark):
    df = spark.createDataFrame([(1, "p", ["a", "b"], ["b", "c"]), (1, "p", ["a", "b"], ["b", "c"]), (None, "p", ["a"], None), (2, "p", None, ["x"])], PAIR)
    found = diff.blocks(df, "i", "n")
    rows = [tuple(r) for r in found.orderBy("i", "block_idx").collect()]
    assert rows == [(1, "p", 0, "removed", "a", None), (1, "p", 1, "context", "b", None), (1, "p", 2, "added", "c", None), (2, "p", 0, "added", "x", None)]
    # lines are dealt once, with their pair; no rows of lines are put in order
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Generate posexplode") == 1


def test_severity_searches_only_texts_that_hold_letters_of_a_pattern(spark):
    assert text.literals([r"going[\s\-]concern", r"\bcovenants?\b|data\s+breach"]) == ["concern", "covenant", "breach"]
    assert text.literals(["(a|b)"]) is None and text.literals(["a.c"]) is None and text.literals(["x*y"]) is None and text.literals(["s?"]) is None
    said = ["Going-Concern", "concern", "a covenant", "covenanted", "Data \t BREACH", "data-breach", "uncertainty", "Market\nrisk", "market", "", None]
    for patterns in (fixed.HIGH_SEVERITY, fixed.MEDIUM_SEVERITY, *([p] for p, _ in fixed.REASONS)):
        assert text.literals(patterns)
        df = spark.createDataFrame([(t,) for t in said], "t string").withColumn("t", F.lower("t"))
        for r in df.select(text.matches_any(F.col("t"), patterns).alias("a"), F.col("t").rlike(text.any_of(patterns)).alias("b")).collect():
            assert r["a"] == r["b"]
