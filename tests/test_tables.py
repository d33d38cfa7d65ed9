"""SQL's table functions against the functions on columns."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import tables, text

TEXTS = [
    'Annual Recurring Revenue (ARR) grew 12.5% to $5 million. "Backlog" means orders that are not yet filled by us. We paid $3,000.\n\nSecond part here. One. Two three four! Is it? Yes it is so',
    None, "", "short", "The Gross Merchandise Value (GMV) rose 3 %. An order refers to something that a customer wants.", "x" * 50, "a b c d e f g h i means nothing at all to us today; $7 billion",
]


@pytest.fixture(scope="module")
def docs(spark):
    tables.register(spark)
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string")


def lateral(spark, docs, name):
    return sorted(map(tuple, spark.sql(f"SELECT k, f.* FROM {{docs}} AS d, LATERAL {name}(d.text) AS f", docs=docs).collect()))


def test_sentences(spark, docs):
    want = text.sentences(docs, "k", "text").select("k", "seq", "paragraph_index", "sentence_index", "text", "word_count")
    found = lateral(spark, docs, "text_sentences")
    assert found == sorted(map(tuple, want.collect())) and len(found) > 6


@pytest.mark.parametrize("name,function", [("text_amounts", text.amounts), ("text_percentages", text.percentages), ("text_acronyms", text.acronyms), ("text_definitions", text.definitions), ("text_quoted", text.quoted_terms)])
def test_arrays(spark, docs, name, function):
    rows = docs.select("k", F.posexplode(function(F.col("text"))).alias("seq", "x"))
    rows = rows.select("k", "seq", "x.*") if "struct" in rows.schema["x"].dataType.simpleString() else rows
    found = lateral(spark, docs, name)
    assert found == sorted(map(tuple, rows.collect())) and found


def test_alone_and_in_a_plan_without_a_join(spark, docs):
    assert [r["amount"] for r in spark.sql("SELECT * FROM text_amounts('from $3 to $4.')").collect()] == ["$3", "$4."]
    plan = spark.sql("SELECT k, a.amount FROM {docs} AS d, LATERAL text_amounts(d.text) AS a", docs=docs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Join" not in plan
