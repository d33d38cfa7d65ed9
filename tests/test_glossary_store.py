"""A glossary that is merged run by run against one made at once."""

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import glossary
from ledgerloom.sources import sinks

ROWS = [
    (1, "c1", "a1", "mda", "s1", 'Annual Recurring Revenue (ARR) grew. "Backlog" means orders that are not yet filled.'),
    (2, "c2", "a2", "risk", "s2", 'Annual Recurring Revenue (ARR) fell. "Backlog" refers to all orders in hand today.'),
    (3, "c1", "a3", "mda", "s3", "Annualised Run Rate (ARR) was flat."),
    (4, None, "a4", None, "s4", "Gross Merchandise Value (GMV) rose."),
    (5, "c3", "a5", "mda", None, "Gross Merchandise Value (GMV) rose."),
    (6, "c3", "a6", "mda", "s6", None),
]


def test_runs_in_any_order_make_one_store(spark, tmp_path):
    s = spark.createDataFrame(ROWS, "seq int, cik string, accession string, section_type string, sentence_id string, text string")
    found = glossary.mentions(s)
    whole = glossary.merged(found, "seq")
    assert sinks.read_glossary(spark, str(tmp_path / "g")) is None
    for part in ("seq IN (2, 5)", "seq = 3", "seq IN (1, 4, 6)", "seq = 3", "false"):
        store = sinks.write_glossary(found.where(part), str(tmp_path / "g"), "seq")
    rows = lambda df: sorted(str(sorted(r.asDict(True).items(), key=str)) for r in df.collect())
    assert set(store) == set(whole)
    for name in whole:
        assert rows(store[name]) == rows(whole[name]), name
    terms = {r["key"]: r for r in store["terms"].collect()}
    assert terms["arr"]["expansion"] == "annual recurring revenue" and terms["arr"]["frequency"] == 2 and terms["arr"]["n_sources"] == 3
    assert terms["gmv"]["frequency"] == 1 and terms["gmv"]["n_sources"] == 1


def test_equal_places_give_one_row_in_any_order(spark):
    ddl = "key string, cik string, accession string, section_type string, sentence_id string, seq int"
    rows = [("k", "c2", "a1", "mda", "s", 1), ("k", "c1", "a2", "risk", "s", 1), ("k", "c0", "a0", "mda", "s", 2)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, ddl).coalesce(1)
        assert [tuple(r) for r in glossary.combined("sources", df).collect()] == [rows[1]]


def test_matches_are_cut_out_of_one_search(spark):
    texts = ["cost of sales, head of the firm", "no match", "", None, "cost of sales \x01 head of firm", "of cost of sales\x02", "the the a an end of all"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    pattern = r"([a-z]{3,30}) of ([a-z]{2,30})"
    a, b = (F.regexp_extract_all("text", F.lit(pattern), F.lit(k)) for k in (1, 2))
    got = df.select(text.pairs_of(F.col("text"), pattern, "x", "y").alias("p"), a.alias("a"), b.alias("b")).collect()
    for r in got:
        assert (r["p"] and [tuple(p) for p in r["p"]]) == (r["a"] and list(zip(r["a"], r["b"]))) or r["p"] == r["a"] == []
    terms = ["the a an Cost", "a the Cost", "an Cost", "The Cost", "theory", " the  a Cost"]
    df = spark.createDataFrame([(t,) for t in terms], "t string").select(text.normalise_term(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == ["cost", "the cost", "cost", "cost", "theory", "a cost"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
