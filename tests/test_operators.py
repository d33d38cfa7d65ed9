"""Operators, functions, sources, sinks and streams on small inputs."""

import datetime
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import fixed, jobs, shared
from ledgerloom.functions import text
from ledgerloom.operators import chat, diff, glossary, graph, noise, vectors
from ledgerloom.plans import graph_queries
from ledgerloom.shared import Table
from ledgerloom.sources import filings, sinks
from ledgerloom.streaming import windows


def one(spark, column):
    return spark.range(1).select(column).collect()[0][0]


def test_tags_and_terms(spark):
    tags = one(spark, text.tags(F.lit("We Expect the Company may grow going forward")))
    assert tags["has_company_coref"] and tags["is_forward_looking"] and tags["fl_indicators"] == [r"\bexpect[s]?\b", r"\bmay\b", "we expect", "going forward"]
    assert not one(spark, text.tags(F.lit("Western willow")))["is_forward_looking"]
    assert not one(spark, text.tags(F.lit("Éour wille")))["has_company_coref"]
    assert one(spark, text.normalise_term(F.lit(" The A Annual Rate"))) == "annual rate"
    found = one(spark, text.acronyms(F.lit("Our Annual Recurring Revenue (ARR); Cost per Unit (CPU) and Non-GAAP Income (NI)")))
    assert [(r["expansion"], r["acronym"]) for r in found] == [("Our Annual Recurring Revenue", "ARR"), ("Cost per Unit", "CPU"), ("Non-GAAP Income", "NI")]
    found = one(spark, text.definitions(F.lit("The term ARR means annual recurring revenue of all. Churn is defined as lost customers in a year; one two three four five six seven means nothing at all here.")))
    assert [r["term"] for r in found] == ["The term ARR", "Churn"]
    assert one(spark, text.quoted_terms(F.lit('"adjusted EBITDA" and "x"'))) == ["adjusted EBITDA"]
    assert one(spark, text.slugify(F.lit("  Foo  Bar-Baz! "))) == "foo_bar_baz"
    assert one(spark, text.amounts(F.lit("about $1.5 billion and $20 "))) == ["$1.5 billion", "$20"]
    assert one(spark, text.percentages(F.lit("5% or 1.25 %"))) == ["5%", "1.25 %"]
    assert one(spark, text.item_code(F.lit("5.02 Departure"))) == "5.02" and one(spark, text.item_code(F.lit("x"))) is None
    assert one(spark, text.domain_tags(F.lit("Cloud revenue risk"))) == ["financial", "risk", "technology"]
    assert one(spark, text.is_self_reference(F.lit("Acme Foods"), F.lit("ACME INC"))) and not one(spark, text.is_self_reference(F.lit("Tyson"), F.lit("ACME INC")))
    assert one(spark, text.metric_names(F.lit("$5; (total net sales) were $1.2 million, x $3"))) == ["revenue", "net sales) were", "$1.2 million, x"]
    assert one(spark, text.market_code(F.lit(" China "))) == "CN" and one(spark, text.market_code(F.lit("Norway"))) == "NORW"
    assert one(spark, text.cik(F.lit("000123"))) == "123" and one(spark, text.cik(F.lit("x"))) is None


def test_answers(spark):
    assert one(spark, text.without_fences(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, text.first_object(F.lit('Sure: {"a": {"b": 1}} ok'))) == '{"a": {"b": 1}}' and one(spark, text.first_object(F.lit("none"))) is None
    r = one(spark, chat.routing(F.lit("no json")))
    assert r["intent"] == "company" and r["company"] is None and r["cypher_hint"] == "general company query"
    r = one(spark, chat.routing(F.lit('```json\n{"intent": "trend", "company": "X", "years": [2020, 2022]}\n```')))
    assert (r["intent"], r["company"], r["years"]) == ("trend", "X", [2020, 2022])
    assert one(spark, chat.primary_source(F.lit("What is the outlook and tone?"))) == "semantic" and one(spark, chat.primary_source(F.lit("list competitors"))) == "graph"


def test_html_and_cleaning(spark):
    html = "<html><head><title>x</title></head><body><script>a<b</script><p>One<br>two</p><table><tr><td>a</td><td>b</td></tr></table>&amp;lt;</body>"
    assert one(spark, text.normalise_whitespace(text.strip_html(F.lit(html)))).split() == ["One", "two", "a", "|", "b", "&lt;"]
    assert one(spark, text.strip_html(F.lit("if x < 3 and y > 2 &amp; z"))) == "if x < 3 and y > 2 &amp; z"
    assert one(spark, text.normalise_whitespace(F.lit("a \t b\r\n\n\n\nc\x01"))) == "a b\n\nc"
    raw = "Table of Contents\nFORWARD-LOOKING STATEMENTS\nBody of forward looking statement here.\n  Page 12 \n 7 \nend"
    assert one(spark, text.clean(F.lit(raw))).split() == ["Body", "of", "here.", "end"]
    assert "forward looking statement" in one(spark, text.clean(F.lit(raw), True))


def test_item_1a(spark):
    words = " ".join(f"word{k}" for k in range(60))
    raw = f"<DOCUMENT>\nItem 1A. Contents\nItem 1B\nbody\n  ITEM 1A Risk Factors\n{words}\n\tmore\nItem 2 Properties\nrest\n</DOCUMENT>\n<DOCUMENT>\nItem 1A\n</DOCUMENT>"
    assert one(spark, text.item_1a(F.lit(raw))) == f"ITEM 1A Risk Factors {words} more"
    assert one(spark, text.item_1a(F.lit(raw.replace(words, "few")))) is None and one(spark, text.item_1a(F.lit("nothing"))) is None
    page = f"<html><body><p>Item 1A</p><div>{words}&nbsp;</div><p>Item 1B</p></body></html>"
    assert one(spark, text.item_1a(F.lit(page))).startswith("Item 1A word0")


def test_sentences(spark):
    df = spark.createDataFrame([(1, "First one is here. Second one is here! no\n\nshort\n\n Third paragraph stands here. "), (2, None)], "k long, t string")
    got = [(r["seq"], r["paragraph_index"], r["sentence_index"], r["text"]) for r in text.sentences(df, "k", "t").orderBy("seq").collect()]
    assert got == [(0, 0, 0, "First one is here."), (1, 0, 1, "Second one is here! no"), (2, 1, 0, "Third paragraph stands here.")]


def test_fiscal_year_and_severity(spark):
    df = spark.createDataFrame([(datetime.date(2023, 2, 14),), (datetime.date(2023, 4, 1),)], "d date")
    assert [r[0] for r in df.select(text.fiscal_year(F.col("d"))).collect()] == [2022, 2023]
    rows = spark.createDataFrame([("a", "HIGH"), ("a", "LOW"), ("b", None)], "k string, s string")
    assert dict(map(tuple, rows.groupBy("k").agg(text.overall(F.col("s"))).collect())) == {"a": "HIGH", "b": "NONE"}
    assert [one(spark, text.severity(F.lit(x))) for x in ("Going-Concern doubt", "uncertainty of supply  chain", "fine")] == ["HIGH", "MED", "LOW"]
    assert one(spark, text.reason(F.lit("A data  breach by default"), F.lit("added"))) == fixed.REASONS[2][1] and one(spark, text.reason(F.lit("x"), F.lit("removed"))) == fixed.REASON_OTHER
    assert len(one(spark, text.last_days(F.lit("2024-01-10").cast("date"), 3))) == 4


def test_merges(spark):
    w = spark.createDataFrame([("n", 1, "x", None), ("n", 2, None, 5), ("n", 3, "y", None), ("m", 1, None, None)], "id string, seq int, p string, q int")
    assert {r["id"]: (r["p"], r["q"]) for r in graph.merge_nodes(w, "id", "seq").collect()} == {"n": ("y", 5), "m": (None, None)}
    e = spark.createDataFrame([("a", "R", "b", 1, "old"), ("a", "R", "b", 2, None)], "s string, r string, o string, seq int, v string")
    assert [tuple(r) for r in graph.merge_edges(e, ["s", "r", "o"], "seq").collect()] == [("a", "R", "b", 2, None)]
    assert graph.assert_unique(w, "id", "seq").count() == 4
    with pytest.raises(Exception, match="repeated"):
        graph.assert_unique(w, "id").collect()


def test_graph(spark):
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("x", "R", "y"), ("a", "Q", "b")], "subject_id string, relation_type string, object_id string")
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("x", "A")], "node_id string, label string")
    assert [tuple(r) for r in graph.valid_edges(edges, nodes, {"R": ("A", "B")}).collect()] == [("a", "R", "b")]
    assert graph.ego(edges, "a").count() == 2 and graph.ego(edges, "a", 2).count() == 3
    left_nodes, left_edges = graph.detach_delete(nodes, edges, spark.createDataFrame([("b",)], "node_id string"))
    assert left_nodes.count() == 3 and [r["subject_id"] for r in left_edges.collect()] == ["x"]
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.components(pairs).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50}
    assert [tuple(r) for r in graph.chain(edges, "R", "R").collect()] == [("a", "b", "c")]
    assert len(graph.chain(edges, "R", "R", optional=True).collect()) == 3
    assert [tuple(r) for r in graph.neighbours(edges, "a", "R").collect()] == [("b", 1)] and [r[0] for r in graph.pointing_at(edges, "b", "R").collect()] == ["a"]
    lines = [r["line"] for r in graph.mermaid(nodes.withColumn("name", F.col("node_id")), edges).collect()]
    assert lines[0] == "graph LR" and "  a -->|R| b" in lines and len(lines) == 9


def test_alias_merge_and_prune(spark):
    nodes = spark.createDataFrame([("g1", "GeographicMarket", "US"), ("g2", "GeographicMarket", "the United States"), ("g3", "GeographicMarket", "PRC"), ("k", "Competitor", "K"), ("l", "Competitor", "Audit Committee"), ("m", "Competitor", "M Corp")], "node_id string, label string, name string")
    rows = [("a", "OPERATES_IN", "g1"), ("a", "OPERATES_IN", "g2"), ("b", "OPERATES_IN", "g1"), ("a", "OPERATES_IN", "g3")] + [(c, "COMPETES_WITH", r) for c, r in ("ak", "al", "bl", "am", "bm")]
    edges = spark.createDataFrame(rows, "subject_id string, relation_type string, object_id string")
    n, e = graph.merge_aliases(nodes, edges, fixed.MARKET_ALIASES, "GeographicMarket")
    assert {r[0] for r in n.select("node_id").collect()} == {"g2", "g3", "k", "l", "m"}
    assert sorted(tuple(r) for r in e.where("relation_type = 'OPERATES_IN'").collect()) == [("a", "OPERATES_IN", "g2"), ("a", "OPERATES_IN", "g3"), ("b", "OPERATES_IN", "g2")]
    assert noise.cleaned(nodes, edges, "Competitor")[0].count() == 6
    n, e = noise.cleaned(nodes, edges, "Competitor", execute=True)
    assert {r[0] for r in n.where("label = 'Competitor'").select("node_id").collect()} == {"m"} and e.where("object_id = 'l'").count() == 0


def test_noise(spark):
    verdict = lambda rule, names, **o: [one(spark, rule(F.lit(n), **o)) for n in names]
    assert verdict(noise.competitor_noise, ["SEC", "Audit Committee", "$ 5 Stock", "Tyson Foods", "IBM", "GE", "The Pacific Exchange"], exact=["SEC"]) == [True, True, True, False, False, True, True]
    assert verdict(noise.market_noise, ["TX", "Q3", "USD", "xx", "Germany", "tx ", "non-U.S. sales", "postp1x"]) == [False, True, True, True, False, False, True, True]
    assert verdict(noise.metric_noise, ["Net revenue", "the sales", "Sales of", "net income", "abc", "Sales 5 million", "Total of x"]) == [False, True, True, True, True, True, True]
    assert one(spark, noise.metric_noise(F.lit("Net revenue"), strict_reference=True))


def test_cross_years(spark):
    rows = [("c", "x", 2020), ("c", "x", 2021), ("c", "y", 2022), ("d", "z", 2020)]
    got = {tuple(r) for r in graph.across_years(spark.createDataFrame(rows, "o string, i string, y int"), "o", "i", "y").collect()}
    assert got == {("c", "x", 2020, "EMERGED_IN"), ("c", "x", 2021, "PERSISTED_TO"), ("c", "x", 2022, "RESOLVED_IN"), ("c", "y", 2022, "EMERGED_IN"), ("d", "z", 2020, "EMERGED_IN")}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, [2.0, 0.0]), (5, None)], "id long, v array<double>")
    assert [tuple(r) for r in vectors.top_k(df, [1.0, 0.0], "id", "v", 3).collect()] == [(1, 1.0), (4, 1.0), (2, 0.6)]
    assert vectors.by_id(df, "id", "v", 99) == []
    got = sorted(tuple(r) for r in vectors.search(df, df.where("id IN (1, 2, 3, 5)"), "id", "v", 2).collect())
    assert got == [(1, 1, 1.0, 1), (1, 4, 1.0, 2), (2, 1, 0.6, 2), (2, 2, 1.0, 1)]
    assert vectors.search(df, df.where("false"), "id", "v", 2).count() == 0


def test_search_in_passes(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = sorted(map(tuple, vectors.search(e, e.where("vec_id < 40"), "vec_id", "embedding", 5).collect()))
    monkeypatch.setattr(vectors, "QUERY_BYTES", 6000)
    assert sorted(map(tuple, vectors.search(e, e.where("vec_id < 40"), "vec_id", "embedding", 5).collect())) == want and len(want) == 200


@pytest.mark.parametrize("scores", [1024, 4096])
def test_search_by_parts_of_the_queries_keeps_ties(spark, monkeypatch, scores):
    monkeypatch.setattr(vectors, "SCORES", scores)
    rng = np.random.default_rng(3)
    m = rng.integers(-1, 2, (3000, 4)).astype(float)  # few directions, so most scores are ties
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, v array<double>").repartition(3)
    got = {}
    for q, i, _, rank in vectors.search(df, df.where("id < 9"), "id", "v", 10).collect():
        got.setdefault(q, []).append((rank, i))
    length = np.sqrt((m * m).sum(axis=1))
    ok = length > 0
    for q in range(9):
        s = np.where(ok, np.round(m @ m[q] / np.where(ok, length, 1) / (length[q] or 1), 9), -9)
        assert [i for _, i in sorted(got.get(q, []))] == (list(np.lexsort((np.arange(3000), -s))[:10]) if ok[q] else [])


def test_filters_and_hits(spark):
    tree = vectors.filters(company=" acme ", years=(2020, 2022), section="management_discussion", forward=True)
    rows = [("a", "ACME", 2021, "mda", True, [1.0, 0.0]), ("b", "ACME", 2019, "mda", True, [1.0, 0.0]), ("c", "X", 2021, "mda", True, [1.0, 0.0]), ("d", "ACME", 2022, "mda", True, [0.0, 1.0])]
    store = spark.createDataFrame(rows, "id string, company_name string, fiscal_year int, section_type string, is_forward_looking boolean, embedding array<double>").withColumn("document", F.lit("said"))
    got = vectors.hits(store, [1.0, 0.0], where=tree)
    assert [(r["id"], r["score"]) for r in got.collect()] == [("a", 1.0), ("d", 0.0)]
    assert "[ACME, FY2021, mda] (relevance: 1.0)" in vectors.hit_lines(got).collect()[0]["line"]
    assert [r["id"] for r in vectors.fetched(store, {"$or": [{"fiscal_year": 2019}, {"company_name": {"$nin": ["ACME"]}}]}, 5).collect()] == ["b", "c"]
    assert vectors.filters() == {} and vectors.filters(years=(2020, 2020)) == {"fiscal_year": {"$eq": 2020}}
    v = store.select(vectors.embedded(store, "document", 8).alias("v")).first()["v"]
    assert len(v) == 8 and sum(abs(x) for x in v) == 1


def test_diff(spark):
    def kinds(a, b):
        return [tuple(r) for r in diff.blocks(spark.createDataFrame([(1, a, b)], "k int, previous array<string>, latest array<string>"), "k").orderBy("block_idx").select("type", "text", "count").collect()]

    assert kinds(["1", "2", "3"], ["1", "2x", "3", "4"]) == [("context", "1", None), ("removed", "2", None), ("added", "2x", None), ("context", "3", None), ("added", "4", None)]
    assert len(kinds(list("abcdefg"), list("abcdefg"))) == 7
    assert [(t, n) for t, _, n in kinds(list("abcdefgh"), list("abcdefgh"))] == [("context", None)] * 3 + [("collapsed", 2)] + [("context", None)] * 3


def test_payload(spark):
    filed = spark.createDataFrame([(a, "1", "T", "Acme", "10-K", datetime.date(2020 + k, 5, 1), 2020 + k) for k, a in enumerate("abc")], "accession string, cik string, ticker string, company_name string, form_type string, filing_date date, fiscal_year int")
    said = [("a", 0, "Same line."), ("a", 1, "Old covenant text."), ("b", 0, " Same line. "), ("b", 1, "New text."), ("b", 2, "A data breach happened."), ("b", 3, " ")]
    s = spark.createDataFrame(said, "accession string, seq int, text string")
    out = {r["id"]: r for r in diff.payload(spark.createDataFrame([("b", "a"), ("c", "c"), ("b", "zz")], "latest string, previous string"), filed, s).collect()}
    assert set(out) == {"b|a", "c|c"}
    r = out["b|a"]
    assert r["severity_score"] == "HIGH" and tuple(r["stats"]) == (2, 1, 1, 3) and r["company"]["name"] == "Acme" and r["previous_filing"]["fiscal_year"] == 2020
    assert [(c["severity"], c["type"]) for c in r["top_changes"]] == [("HIGH", "removed"), ("HIGH", "added"), ("LOW", "added")]
    assert [b["type"] for b in r["diff_blocks"]] == ["context", "removed", "added", "added"]
    assert out["c|c"]["severity_score"] == "NONE" and out["c|c"]["stats"]["total_changes"] == 0


def test_adjacent_over_ranges(spark):
    rows = [("hot", k) for k in range(500)] + [("a", 3), ("a", 9), ("z", 1)]
    got = {tuple(r) for r in diff.adjacent(spark.createDataFrame(rows, "g string, k long").repartition(5), "g", "k").collect()}
    assert got == {("hot", k, k - 1) for k in range(1, 500)} | {("a", 9, 3)}


def test_glossary(spark):
    s = spark.createDataFrame([
        ("1", "a", "mda", "s1", 0, "Annual Recurring Revenue (ARR) rose."), ("2", "b", "business", "s2", 1, "ARR means annual recurring revenue of customers."),
        ("2", "b", "business", "s3", 2, "Adjusted Recurring Revenue (ARR) fell. ARR means something else entirely."), ("3", "c", "mda", "s4", 3, None),
    ], "cik string, accession string, section_type string, sentence_id string, seq int, text string")
    out = {r["term"]: r for r in glossary.nested(glossary.merged(glossary.mentions(s), "seq"), sources=True).collect()}
    r = out["arr"]
    assert r["definition"] == "annual recurring revenue of customers" and r["expansion"] == "annual recurring revenue" and r["is_acronym"]
    assert (r["frequency"], r["aliases"], r["scopes"], r["sources"]) == (2, ["annual recurring revenue", "adjusted recurring revenue"], ["mda", "business"], ["s1", "s2", "s3"])
    assert r["tags"][0] == "financial"


def test_section_files(spark, tmp_path):
    good = "CIK: 0001001\nCompany Name: EXAMPLE CORP\nForm Type: 10-K\nFiling Date: 2023-02-14\nAccession Number: 0001-23-1\n\nWe expect demand.\n\nAccession Number: 9\nMore."
    (tmp_path / "2022").mkdir()
    (tmp_path / "2022" / "a.txt").write_text(good)
    (tmp_path / "b.txt").write_text("no header here")
    (tmp_path / "c.txt").write_text("\ncik: 7\ncompany name: Low\nfiling date: soon\n\nbody")
    (tmp_path / "d.csv").write_text("CIK: 1\n\nx")
    rows = {r["cik"]: r for r in filings.section_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"1001", "7"} and rows["1001"]["fiscal_year"] == 2022 and rows["1001"]["accession_number"] == "0001-23-1" and rows["1001"]["folder_year"] == 2022
    assert rows["1001"]["body"] == "We expect demand.\n\nAccession Number: 9\nMore." and rows["7"]["filing_date"] is None and rows["7"]["body"] == "body"
    assert {tuple(r) for r in filings.file_counts(spark, str(tmp_path)).collect()} == {(2022, 1), (None, 2)}


SGML = "<SEC-HEADER>\nACCESSION NUMBER:\t\t0001-20-7\nITEM INFORMATION:\tOther Events\nITEM INFORMATION:\tExhibits\nFILED AS OF DATE:\t20200304\nCOMPANY CONFORMED NAME:\tX INC\nCENTRAL INDEX KEY:\t0000123\n</SEC-HEADER>\n<DOCUMENT>\n<TYPE>8-K\n<TEXT>\nhello ITEM\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-99\n<TEXT>\nno\n</TEXT>\n</DOCUMENT>\nITEM INFORMATION: Late"


def test_event_files_and_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text(SGML)
    (tmp_path / "77_8-K_x.txt").write_text(SGML.replace("ACCESSION NUMBER", "ACCESSION").replace("<TYPE>8-K", "<TYPE>10-K"))
    rows = {r["accession"]: r for r in filings.event_files(spark, str(tmp_path)).select("*", filings.with_preamble(F.col("items"), F.col("body_html")).alias("b")).collect()}
    row = rows["0001-20-7"]
    assert (str(row["filing_date"]), row["cik"], row["b"].strip(), row["items"]) == ("2020-03-04", "123", "Items reported: Other Events; Exhibits.\n\nhello ITEM", ["Other Events", "Exhibits"])
    assert rows["77_8-K_x"]["body_html"] == ""
    (tmp_path / "e.csv").write_text("CIK No,Company Name,Date Filed,Accession Number,Item\n0042,X,2020-02-01,00-1,5.02 Departure\n42,X,,00-2,1.01 Deal\n42,X,2020-05-02,00-3,77\n,X,2020-05-02,00-3,77\n")
    rows = filings.item_events(filings.delimited(spark, str(tmp_path / "e.csv")))
    assert sorted((r["event_id"], r["cik"], r["code"], r["category"], r["fiscal_year"]) for r in rows.collect()) == [("8k_42_001_5_02", "42", "5.02", "officer_director_change", 2019), ("8k_42_003_77", "42", None, "other", 2020)]
    nodes, edges = filings.event_graph(rows, spark.createDataFrame([("9",)], "cik string"))
    assert nodes.count() == 2 and {r["relation_type"] for r in edges.collect()} == {"FILED_IN"}


def test_index_and_ticker_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("CIK,Company Name,Form.Type\n01,A,10-K\n2,B,8-K\n3,C,10-K405\n")
    (tmp_path / "b.csv").write_text("cik_no,form type,extra\n4,10-K,x\n")
    index = filings.index_tables(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), str(tmp_path / "missing.csv")])
    assert index.count() == 4 and set(index.columns) == {"cik", "company", "form_type", "extra"}
    (tmp_path / "t.csv").write_text("Ticker,CIK\nzz,0001\naa,1\nBB,4\n")
    t = filings.tickers(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in filings.filers(index, t).collect()] == [("1", "aa"), ("4", "BB")]
    assert {tuple(r) for r in filings.cik_by_ticker(t).collect()} == {("ZZ", "1"), ("AA", "1"), ("BB", "4")}


def test_from_files_to_graph_and_delta(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    head = "CIK: 00{0}\nCompany Name: Acme Corp\nForm Type: 10-K\nFiling Date: {1}-05-01\nAccession Number: {2}\n\n"
    (src / "a.txt").write_text(head.format(1, 2020, "acc-a") + "We compete with Tyson Foods here.\n\nWe expect strong growth in Germany next year. Net sales rose to $5 million this year.")
    (src / "b.txt").write_text(head.format(1, 2021, "acc-b") + "We compete with Tyson Foods here.\n\nA data breach happened in our systems.")
    (tmp_path / "t.csv").write_text("Ticker,CIK\nACM,0001\nTYSON,55\n")
    docs = jobs.run_preprocessing(spark, str(src), f"{out}/sections", "mda", str(tmp_path / "t.csv"))
    assert docs.count() == 2 and jobs.run_preprocessing(spark, str(src), f"{out}/sections", "mda").count() == 2
    row = docs.where("section_id = '1_acc-a_mda'").first()
    assert row["metadata"]["ticker"] == "ACM" and row["sentence_count"] == 3 and row["sentences"][1]["is_forward_looking"] and row["sentences"][2]["sentence_id"] == "acc-a_mda_0002"
    assert Table(spark, f"{out}/sections").versions() == [1, 2]
    gazetteer = spark.createDataFrame([("Tyson Foods", "ORG"), ("Germany", "GPE"), ("Acme Corp", "ORG")], "name string, label string")
    extractor = jobs.gazetteer_extractor(gazetteer)
    table = filings.tickers(spark, str(tmp_path / "t.csv"))
    plan = jobs.run_kg_population(docs, f"{out}/graph", extractor, table, dry_run=True)
    assert {r["of"]: r["n"] for r in plan.where("kind = 'node'").collect()}["Competitor"] == 2 and sinks.GraphStore(spark, f"{out}/graph").nodes() is None
    told = []
    jobs.run_kg_population(docs, f"{out}/graph", extractor, table, report=told.append)
    totals = {r["kind"]: r["n"] for r in plan.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    assert [(t["documents"], t["nodes"], t["edges"]) for t in told] == [(2, totals["node"], totals["edge"])] and told[0]["rate"] > 0
    store = sinks.GraphStore(spark, f"{out}/graph")
    nodes, edges = store.nodes(), store.edges()
    assert nodes.where("label = 'Competitor'").first()["node_id"] == "comp_55" and nodes.where("label = 'FiscalYear'").count() == 35
    e = {(r["subject_id"], r["relation_type"], r["object_id"]): r for r in edges.collect()}
    assert e["1", "COMPETES_WITH", "comp_55"]["filing_refs"] == ["acc-a", "acc-b"] and e["1", "COMPETES_WITH", "comp_55"]["filing_ref"] == "acc-b"
    assert ("1", "OPERATES_IN", "geo_de") in e and ("1", "REPORTS", "1_acc-a_metric_sales_rose_to") in e and ("1", "HAS_OUTLOOK", "1_acc-a_outlook_0001") in e
    assert ("acc-a", "FILED_IN", "fy_2020") in e and ("fy_1993", "PRECEDES", "fy_1994") in e
    jobs.run_kg_population(docs, f"{out}/graph", extractor, table)
    assert store.nodes().count() == nodes.count() and store.edges().count() == len(e)
    assert jobs.progress(docs.select("section_id"), store.nodes().where("label = 'Section'").select(F.col("node_id").alias("section_id")), "section_id").first()["percent"] == 100.0
    page = jobs.statistics_page(store.nodes(), store.edges())
    assert page["range"].first()[:] == (2020, 2021) and page["competitors"].first()["name"] == "Tyson Foods"
    gone = jobs.clean_names(spark, f"{out}/graph", "FinancialMetric", execute=True)
    assert gone.count() == store.nodes().where("false").count() + gone.count() and store.edges().where("relation_type = 'REPORTS'").count() == 1 - gone.count()
    index = sinks.Index(spark, f"{out}/index")
    assert jobs.reindex(index, docs) == {"companies": 1, "filings": 2} == jobs.health(index)
    said = filings.sentences(docs).select(F.col("accession_number").alias("accession"), "seq", "text")
    first = jobs.delta(index, said, "acc-b", "acc-a").first()["data"]
    assert '"severity_score":"HIGH"' in first and jobs.delta(index, said.where("false"), "acc-b", "acc-a").first()["data"] == first
    assert jobs.list_companies(index.read("companies"), index.read("filings"), "acm").first()["filing_count"] == 2
    assert jobs.list_companies(index.read("companies"), index.read("filings"), offset=5).count() == 0
    terms = jobs.run_glossary(docs, f"{out}/glossary")
    assert set(terms) == {"terms", "aliases", "scopes", "tags", "sources"} and sinks.read_glossary(spark, f"{out}/glossary") is not None
    tables = {"companies": index.read("companies"), "filings": index.read("filings"), "nodes": store.nodes(), "edges": store.edges()}
    assert chat.template(spark, "competitors_of", tables, cik="1").first()["competitor"] == "Tyson Foods"
    assert chat.template(spark, "markets_of", tables, cik="1").first()["markets"] == ["Germany"]
    assert chat.diagnosed(spark, tables, "1").first()["available_years"] == [2020, 2021] and "type" in chat.diagnosed(spark, tables, "99").columns
    for name in chat.TEMPLATES:
        params = {k: v for k, v in {"cik": "1", "market": "ger", "first": 2000, "last": 2030, "year": 2020, "section": "mda"}.items() if f":{k}" in chat.TEMPLATES[name]}
        assert chat.template(spark, name, tables, **params).count() >= (0 if name == "metrics" else 1)
    lines = chat.row_lines(tables["companies"]).first()["line"]
    assert lines.startswith("• cik: 1  |  ") and "name: Acme Corp" in lines


def test_section_documents_from_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"section_id": "s", "section_type": "mda",\n "metadata": {"cik": "1", "accession_number": "x", "filing_date": "2020-01-02", "company_name": "A"}, "sentences": [{"text": "Hi", "sentence_id": "q"}], "source_file": "f1"}')
    (tmp_path / "b.json").write_text("not json at all")
    (tmp_path / "c.json").write_text('{"section_id": "t", "metadata": {"cik": "2"}}')
    docs = filings.section_documents(spark, str(tmp_path))
    assert {r[0] for r in filings.section_keys(docs).collect()} == {"s", "t"}
    assert [r["text"] for r in filings.sentences(docs).collect()] == ["Hi"]
    companies, filed = filings.filing_index(docs)
    assert companies.count() == 1 and filed.first()["form_type"] == "10-K"


def test_read_only():
    assert chat.is_read_only("SELECT 1") and chat.is_read_only(" with x as (select 'DROP it' as a) select * from x")
    for q in ("DROP TABLE x", "select 1; delete from x", "INSERT INTO x SELECT 1", "SELECT 1 -- x\n; DROP TABLE y", "explain select 1", "SELECT * FROM x MERGE"):
        assert not chat.is_read_only(q)
    with pytest.raises(ValueError):
        chat.ask(None, "DELETE FROM x")


def test_additions_skip_what_is_there(spark, tmp_path):
    rows = lambda ids: spark.createDataFrame([(str(i), f"d{i}", [1.0]) for i in ids], "id string, document string, embedding array<double>")
    assert sinks.add_vectors(rows([1, 2, 2]), str(tmp_path / "v")) == 2 and sinks.add_vectors(rows([2, 3]), str(tmp_path / "v")) == 1
    assert spark.read.parquet(str(tmp_path / "v")).count() == 3 and vectors.unseen(rows([1]), rows([1, 4])).count() == 1
    index = sinks.Index(spark, str(tmp_path / "i"))
    for name in ("A", "B"):
        index.replace_rows("companies", spark.createDataFrame([("1", name, None)], "cik string, name string, ticker string"))
    assert [tuple(r) for r in index.read("companies").collect()] == [("1", "B", None)]
    sinks.save_session(rows([1]), str(tmp_path / "s"))
    assert sinks.load_session(spark, str(tmp_path / "s")).count() == 1 and sinks.load_session(spark, str(tmp_path / "none")) is None


def test_a_version_that_failed_is_not_read(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.write(spark.range(3))
    os.makedirs(tmp_path / "t" / "v=2")
    assert t.read().count() == 3 and t.write(spark.range(5)).count() == 5 and t.versions() == [3]


def test_stream_counts_as_the_table_does(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    want = windows.sliding(table, "ts", "event_type", "2 days", "1 day")
    query = windows.sliding(stream, "ts", "event_type", "2 days", "1 day").writeStream.outputMode("complete").format("memory").queryName("sliding").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(str, spark.sql("SELECT * FROM sliding").collect())) == sorted(map(str, want.collect()))
    windows.write_batches(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == table.count()
    windows.merge_batches(stream, f"{tmp_path}/users", ["user_id"], "ts", "event_id", checkpoint=f"{tmp_path}/cp2").awaitTermination()
    last = table.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    got = Table(spark, f"{tmp_path}/users").read()
    assert sorted(tuple(r) for r in got.select("user_id", "event_id").collect()) == sorted(tuple(r) for r in last.collect())
    nodes = stream.select(F.col("user_id").cast("string").alias("node_id"), F.lit("Company").alias("label"), F.when(F.col("value") > 5, F.col("value")).alias("v"), "event_id")
    windows.merge_nodes(nodes, f"{tmp_path}/nodes", "event_id", f"{tmp_path}/cp3").awaitTermination()
    want = table.where("value > 5").groupBy("user_id").agg(F.max_by("value", "event_id").alias("v"))
    assert {int(r["node_id"]): r["v"] for r in Table(spark, f"{tmp_path}/nodes").read().where("v IS NOT NULL").collect()} == {r["user_id"]: r["v"] for r in want.collect()}


def test_new_rows_and_conversations_in_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "b")]
    spark.createDataFrame(rows, "ts string, k string").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "k").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/in")
    windows.new_rows(stream, ["k"], "ts", "1 hour").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/o").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/o").count() == 2
    turns = [("x", k, f"q{k}", "Acme" if k == 2 else "") for k in range(11)] + [("y", 0, "q", None)]
    schema = "conversation string, turn long, question string, company string"
    spark.createDataFrame(turns, schema).write.parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/t")
    windows.conversation_state(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c2").trigger(once=True).start(f"{tmp_path}/o2").awaitTermination(60)
    got = {(r["conversation"], r["turn"]): (r["held"], r["company"]) for r in spark.read.parquet(f"{tmp_path}/o2").collect()}
    assert got["x", 1] == (2, None) and got["x", 10] == (8, "Acme") and got["y", 0] == (1, None) and len(got) == 12


@pytest.mark.parametrize("most", [200_000, 0])
def test_companies_are_resolved_by_equal_substrings(spark, monkeypatch, most):
    monkeypatch.setattr(chat, "BROADCAST_TERMS", most)
    names = ["Acme Holdings", "ACME", "Straße AG", "aaaa", "", None, "Zeta acme Zeta"]
    rows = [(str(k), f"T{k}", n) for k, n in enumerate(names)]
    asked = ["acme", "Acme H", "t3", "aa", "", "ß", "zeta acme zeta and more", "nobody", None, "holdings"]
    c = spark.createDataFrame(rows, "cik string, ticker string, name string")
    out = chat.resolved_companies(spark.createDataFrame([(t, None) for t in asked], "term string, cik string"), c)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = set()
    for t in asked:
        hits = [(len(n) if n is not None else -1, k, n) for k, tick, n in rows if t is not None and (tick.lower() == t.lower() or n is not None and t.lower() in n.lower())]
        want.add((t, *(min(hits)[1:] if hits else (None, None))))
    assert {tuple(r) for r in out.collect()} == want


@pytest.mark.parametrize("group", [64, 128, 1 << 15])
def test_sharing_by_pairs_of_groups(spark, monkeypatch, group):
    monkeypatch.setattr(graph, "GROUP", group)
    monkeypatch.setattr(graph, "HELD", 3)
    rng = np.random.default_rng(2)
    edges = [(int(a) * 10**12 - 5, f"o{b}") for a, b in rng.integers(0, [400, 90], (500, 2))]
    of = {}
    for a, b in edges:
        of.setdefault(a, set()).add(b)
    want = {a: n for a in of if (n := sum(b > a and bool(of[a] & of[b]) for b in of))}
    df = spark.createDataFrame([*edges, *edges[:9], (7, None), (None, "o1")], "subject long, object string")
    assert {r["subject"]: r["sharing"] for r in graph.sharing(df).collect()} == want


def test_ego_rows_of_a_task_are_bounded(spark, monkeypatch):
    rng = random.Random(4)
    name = lambda: rng.choice([None, "a", *(f"n{rng.randrange(60)}" for _ in range(8))])
    rows = [(name(), rng.choice(["R", "Q"]), name()) for _ in range(150)] * 2
    edges = spark.createDataFrame(rows, "subject_id string, relation_type string, object_id string")
    monkeypatch.setattr(shared, "TASK_ROWS", 10)
    near = {"a"}
    for hops in (1, 2, 3):
        for most in (graph.BROADCAST_NODES, 0):
            monkeypatch.setattr(graph, "BROADCAST_NODES", most)
            found = graph.ego(edges, "a", hops)
            assert sorted(map(str, found.collect())) == sorted(str(r) for r in edges.distinct().collect() if {r[0], r[2]} & near)
            assert found.rdd.getNumPartitions() == len(rows) / 10
        near |= {x for s, _, o in rows if {s, o} & near for x in (s, o) if x is not None}
    assert graph.ego(edges, "nowhere", 3).count() == 0


def test_edges_of_the_tables_whatever_the_rows_of_a_task(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    whole = sorted(map(str, graph_queries.graph_edges(spark, folder).collect()))
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    dealt = graph_queries.graph_edges(spark, folder)
    assert sorted(map(str, dealt.collect())) == whole and len(set(whole)) == len(whole)
    sections = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert dealt.rdd.getNumPartitions() == 2 * -(-sections // 500)
    assert sorted(map(str, graph_queries.market_edges(spark, folder).collect())) == [x for x in whole if "OPERATES_IN" in x]
