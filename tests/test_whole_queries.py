"""Queries without SQL, over whole tables, against brute force."""

import html
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions import text
from ledgerloom.operators import graph
from tests.brute_diff import block_rows
from ledgerloom.plans import catalog, text_queries

SF = "/root/testdata/sf0.001"
RANK = {"HIGH": 0, "MED": 1, "LOW": 2}


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def split_sentences(text):
    """(paragraph, sentence, text, words) of a text."""
    out, paragraphs = [], [p.strip(" ") for p in re.split(r"\n{2,}", text or "")]
    for i, p in enumerate(p for p in paragraphs if len(p) >= 10):
        parts = [s.strip(" ") for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z])", p)]
        out += [(i, j, s, len(re.findall(r"[^ \t\n\r\f]+", s))) for j, s in enumerate(x for x in parts if x)]
    return [x for x in out if x[3] >= 3]


def test_sentence_segmentation(spark):
    got = defaultdict(list)
    for r in catalog.QUERIES["sentence_segmentation"](spark, SF).orderBy("doc_id", "seq").collect():
        t = r["tags"]
        got[r["doc_id"]].append((r["paragraph_index"], r["sentence_index"], r["text"], r["word_count"]))
        assert t["is_forward_looking"] == bool(t["fl_indicators"]) and t["fl_indicators"] == [p for p in fixed.FORWARD_LOOKING if re.search(p, r["text"], re.I)]
        assert t["has_company_coref"] == any(re.search(p, r["text"], re.I) for p in fixed.COMPANY_REFERENCES)
    assert got == {r["doc_id"]: s for r in documents(spark) if (s := split_sentences(r["text"]))}


def test_sentence_ids(spark):
    got = {(r["doc_id"], r["sentence_id"], r["word_count"]) for r in catalog.QUERIES["sentence_ids"](spark, SF).collect()}
    want = {(r["doc_id"], f"{r['doc_id']}_{r['lang'] or 'none'}_{k:04d}", s[3]) for r in documents(spark) for k, s in enumerate(split_sentences(r["text"]))}
    assert got == want


class Plain(HTMLParser):
    """Words of a page outside scripts, styles and head."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_html_strip(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in catalog.QUERIES["html_strip"](spark, SF).collect():
        p = Plain()
        p.feed(pages[r["page_id"]])
        assert "".join(r["text"].split()) == "".join(p.words), r["page_id"]
        assert not re.search(r"<[a-z]", pages[r["page_id"]]) or "<p>" not in r["text"]


def severity(text):
    words = set(re.findall(r"\w+", (text or "").lower()))
    return "HIGH" if words & {"idiot", "with"} else "MED" if words & {"from", "this"} else "LOW"


def test_severity_in_all_languages(spark, tmp_path):
    docs = documents(spark)
    got = {r["doc_id"]: r["severity"] for r in catalog.QUERIES["severity_scoring"](spark, SF).collect()}
    assert got == {r["doc_id"]: severity(r["text"]) for r in docs} and len(got) == len(docs)
    want = {}
    for r in docs:
        want[r["source"]] = min(want.get(r["source"], "LOW"), severity(r["text"]), key=RANK.get)
    assert {r["source"]: r["severity"] for r in catalog.QUERIES["overall_severity"](spark, SF).collect()} == want
    rows = [(0, "fromé", "fr", "a", 5), (1, "été from", None, "b", 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["source"]: r["severity"] for r in catalog.QUERIES["overall_severity"](spark, str(tmp_path)).collect()}
    assert got == {"a": "LOW", "b": "MED"}


def pairs(spark):
    """(latest, lines of the previous, lines of the latest) of neighbouring documents of a source."""
    by = defaultdict(list)
    for r in sorted(documents(spark), key=lambda r: r["doc_id"]):
        by[r["source"]].append((r["doc_id"], [x.strip(" ") for x in (r["text"] or "").split("\n") if x.strip(" ")]))
    return [(b[0], a[1], b[1]) for v in by.values() for a, b in zip(v, v[1:])]


def test_sentence_diff_of_all_neighbours(spark):
    want = {(i, k, *b) for i, before, after in pairs(spark) for k, b in enumerate(block_rows(before, after))}
    got = catalog.QUERIES["sentence_diff"](spark, SF).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    assert all((r["severity"] is not None) == (r["type"] in ("added", "removed")) for r in got)


def test_delta_stats(spark):
    want = {}
    for i, before, after in pairs(spark):
        n = Counter(b[0] for b in block_rows(before, after))
        if n:
            want[i] = (n["added"], n["removed"], n["context"], n["added"] + n["removed"])
    assert {r["doc_id"]: tuple(r)[1:5] for r in catalog.QUERIES["delta_stats"](spark, SF).collect()} == want


def test_metric_stubs(spark):
    got = {r["doc_id"]: (r["names"], r["amounts"]) for r in catalog.QUERIES["metric_stubs"](spark, SF).collect()}
    n = 0
    for r in documents(spark):
        text = r["text"]
        for word, unit in (("the", ".5 million"), ("der", ",000"), ("les", " billion"), ("los", ".25")):
            text = text.replace(f" {word} ", f" ${r['doc_id'] % 997}{unit} ")
        names, amounts = [], []
        for m in re.finditer(fixed.MONEY, text, re.I):
            context, raw = text[max(0, m.start() - 40) : m.end() + 40], m.group().strip()
            names.append(" ".join(context[: context.find(raw)].split()[-3:]).strip(".,;:()") or "revenue")
            amounts.append(raw)
        assert got[r["doc_id"]] == (";".join(names), ";".join(amounts))
        n += len(amounts)
    assert n > 100


def test_entity_extraction(spark):
    docs = [r for r in documents(spark) if r["text"] is not None]
    n = Counter(w for r in docs for w in re.findall(r"\b([A-Z][a-z]{4,9})\b", r["text"]))
    known = {w.lower(): "ORG" if len(w) % 2 == 0 else "GPE" for w, k in n.items() if k >= 50}
    got = {r["doc_id"]: tuple(r)[1:] for r in catalog.QUERIES["entity_extraction"](spark, SF).collect()}
    for r in docs:
        found = {}
        for w in r["text"].split():
            name = re.sub(r"^[^\w]+|[^\w.]+$|^_+", "", w)
            if name[:1].isupper() and name.lower() in known:
                found[name.lower()] = known[name.lower()]
        company = set(r["source"].lower().split())
        orgs = sum(v == "ORG" and k not in company and k not in fixed.SELF_REFERENCES for k, v in found.items())
        geos = sum(v == "GPE" for v in found.values())
        ahead = int("the" in r["text"].lower())
        assert got.get(r["doc_id"], (0, 0, 0, 0)) == (orgs, geos, ahead, orgs + geos + ahead)


def test_approximate_counts_lie_near(spark):
    exact = {r["market"]: r["companies"] for r in catalog.QUERIES["stats_top_markets"](spark, SF).collect()}
    for r in catalog.QUERIES["approx_companies_per_market"](spark, SF).collect():
        assert r["market"] not in exact or abs(r["companies"] - exact[r["market"]]) <= 0.15 * exact[r["market"]]


def edges(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    found = orders.join(spark.read.parquet(f"{SF}/lineitem.parquet"), orders.o_orderkey == F.col("l_orderkey"))
    return {tuple(r) for r in found.select("o_custkey", "l_suppkey").distinct().collect()}


def sharing(found):
    of, near = defaultdict(set), defaultdict(set)
    for cik, rival in found:
        of[rival].add(cik)
    for cik, rival in found:
        near[cik] |= {b for b in of[rival] if b > cik}
    return {k: len(v) for k, v in near.items() if v}


def test_shared_competitors_over_all_edges(spark):
    got = {r["company"]: r["sharing"] for r in catalog.QUERIES["shared_competitor_pairs"](spark, SF).collect()}
    assert got == sharing(edges(spark))


def test_shared_competitors_across_buckets_of_bits(spark, tmp_path):
    rng = random.Random(5)
    ciks = [1, 7, 8, 9, 16, 32767, 32768, 32769, 32776, 65536, 65537, 100_000]
    found = {(c, rng.randrange(9)) for c in ciks for _ in range(2)}
    rows = list(enumerate(sorted(found)))
    spark.createDataFrame([(k, c) for k, (c, _) in rows], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, r) for k, (_, r) in rows], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["company"]: r["sharing"] for r in catalog.QUERIES["shared_competitor_pairs"](spark, str(tmp_path)).collect()}
    assert got == sharing(found)


def test_prune_keeps_rivals_of_any_number(spark):
    found = edges(spark)
    degree = Counter(r for _, r in found)
    got = {tuple(r) for r in catalog.QUERIES["competitor_prune"](spark, SF).select("cik", "rival").collect()}
    assert got == {(c, r) for c, r in found if degree[r] > 1} and any(r % 10 == 0 for _, r in got)


def test_character_references(spark):
    from ledgerloom.functions import text

    samples = ["&amp;lt; &#65;&#x42; &eacute;&nope; a & b &#0; &#55296; &apos;&nbsp;|", "none", "", "&amp;", "x &lt;y&gt;&#8212;", "&#1114112;", "tail&copy;"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string").orderBy("i").select(text.unescape(F.col("t"))).collect()]
    want = [s if s in ("&#1114112;",) else html.unescape(s) for s in samples]
    assert got[1:] == want[1:] and got[0] == "&lt; AB é&nope; a & b &#0; &#55296; '\xa0|"
    assert text_queries.TERM.count("(") == 3


def test_metric_names_look_back_no_further_than_they_need(spark):
    texts = ["", None, "no amount", "".join(f"{'w ' * (n // 2)}{'x' * (n % 2)}$1 million" for n in (0, 1, 38, 39, 40, 41, 90, 3)), "a b $1 c $2 d $3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    names = text.metric_names(F.col("t"))
    for r in df.select("t", names.alias("names")).collect():
        want = None if r["t"] is None else []
        for m in re.finditer(fixed.MONEY, r["t"] or "", re.I):
            context = r["t"][: m.start()][-40:] + m[0]
            words = context.split(m[0].strip())[0].split()[-3:]
            want.append(re.sub(r"^[.,;:()]+|[.,;:()]+$", "", " ".join(words)) or "revenue")
        assert r["names"] == want
    # texts without a dollar aren't searched, and long gaps between amounts aren't put together with those before
    plan = df.select(names.alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan and ">= 40" in plan


@pytest.mark.parametrize("ciks", [[20, 21, 77777, 77780], [20, 77778], []])
def test_a_stranger_stays_one_where_a_company_has_its_number(spark, tmp_path, ciks):
    rows = [(k, f"Customer#{k:09d}", "BUILDING") for k in ciks] + [(40, "Nobody & Co", None)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.QUERIES["company_resolution"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["company_resolution"]).fetchall()
    assert Counter(map(tuple, got)) == Counter(want) and ("nobody", "77777", None) in want


def test_an_object_goes_to_pairs_of_groups_as_one_row_a_group(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST", 64)
    monkeypatch.setattr(graph, "GROUPS", 4)
    monkeypatch.setattr(graph, "MARKS", 512)
    rng = random.Random(8)
    # objects that all, many, few and two subjects have; some edges twice
    found = [(s, 0) for s in range(0, 300)] + [(rng.randrange(300), 1) for _ in range(200)] + [(rng.randrange(900), rng.randrange(2, 200)) for _ in range(1500)]
    rows = spark.createDataFrame([*found, *found[:400], (None, 1), (5, None)], "subject long, object long")
    assert {r["subject"]: r["sharing"] for r in graph.sharing(rows).collect()} == sharing(set(found))
    batches = [pa.RecordBatch.from_pydict({"nth": [s for s, o in part], "h": [o for s, o in part]}) for part in (found[:900], found[900:])]
    sets = [(g, h, c) for b in graph._sets(batches, 64) for g, h, c in zip(*b.to_pydict().values())]
    want = defaultdict(set)
    for s, o in found:
        want[s // 64, o].add(s % 64)
    assert len(sets) == len(want) and all(c == sorted(want[g, h]) for g, h, c in sets)
