"""The normaliser against a plain version that takes one document at a time."""

import json
import random
import re

from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.operators import graph, normalise

META = "cik string, accession string, section_type string, ticker string, company_name string, form_type string, filing_date date, fiscal_year int, word_count long"
TICKERS = {"TSN": "100", "ABC": "7"}


def slug(x):
    return re.sub(r"[^a-z0-9]+", "_", x.lower().strip()).strip("_")[:60]


def plain(cik, acc, section, company, year, record):
    """(nodes by id, edges) of one document."""
    nodes, edges, index, seq = {cik: "Company", acc: "Filing", f"{cik}_{acc}_{section}": "Section"}, [], {company.lower(): cik}, {}
    edges += [(acc, "FILED_BY", cik), (acc, "HAS_SECTION", f"{cik}_{acc}_{section}")]
    edges += [(acc, "FILED_IN", f"fy_{year}")] if fixed.FIRST_YEAR <= year <= fixed.LAST_YEAR else []
    for n in record.get("nodes") or []:
        t = n.get("type")
        label = lambda *keys, default: next((n[k] for k in keys if n.get(k)), default)  # noqa: B023, E731
        plainly = lambda default: n["name"] if n.get("name") is not None else default  # noqa: B023, E731
        implied = None
        if t in ("RiskFactor", "Mitigation", "ManagementOutlook"):
            seq[t] = seq.get(t, 0) + 1
            if t == "RiskFactor":
                title = n["title"] if n.get("title") is not None else "Untitled Risk"
                node, key, implied = f"{cik}_{acc}_risk_{seq[t]:04d}", title.lower(), "HAS_RISK"
            elif t == "Mitigation":
                node = f"mit_{cik}_{acc}_{seq[t]:04d}"
                key = (label("description", "title", default="") or node).lower()[:60]
            else:
                node, key, implied = f"{cik}_{acc}_outlook_{seq[t]:04d}", label("text", "name", "description", default="")[:40].lower(), "HAS_OUTLOOK"
        else:
            if t in ("RiskDriver", "RiskConsequence"):
                name = label("title", "name", default=f"Unknown {t[4:]}")
                node = {"RiskDriver": "rd_", "RiskConsequence": "rc_"}[t] + slug(name)
            elif t == "BusinessSegment":
                name = plainly("Unknown Segment")
                node = f"{cik}_{year}_seg_{slug(name)}"
            elif t == "Product":
                name = plainly("Unknown Product")
                node = f"{cik}_{year}_prod_{slug(name)}"
            elif t == "GeographicMarket":
                name = plainly("")
                iso = n.get("iso_code") or fixed.MARKET_CODES.get(name.lower().strip(), name.upper()[:4])
                node = f"geo_{iso.lower()}"
            elif t == "CustomerSegment":
                name = label("name", "label", default="Unknown")
                node = f"cs_{slug(name)}"
            elif t == "Competitor":
                name = plainly("Unknown Competitor")
                known = TICKERS.get((name.upper().split() or [""])[0])
                node = f"comp_{known}" if known else f"comp_{slug(name)}"
            elif t == "Regulation":
                name = plainly("Unknown Regulation")
                node = f"reg_{slug(name)}"
            elif t == "FinancialMetric":
                name = plainly("Unknown Metric")
                node, implied = f"{cik}_{acc}_metric_{slug(name)}", "REPORTS"
            elif t == "Driver":
                name = plainly("Unknown Driver")
                node = f"drv_{slug(name)}"
            elif t == "MacroFactor":
                name = plainly("Unknown Factor")
                node = f"macro_{slug(name)}"
            else:
                continue
            key = name.lower()
            if node in nodes:
                continue
        nodes[node], index[key] = t, node
        edges += [(cik, implied, node)] if implied else []
    for r in record.get("relations") or []:
        ends = []
        for e in ("subject_title", "object_title"):
            name = (r.get(e) or "").lower()
            end = index.get(name) if name else None
            if name and end is None:
                end = cik if name in company.lower() or company.lower() in name else next((v for k, v in index.items() if k.startswith(name[:20])), None)
            ends.append(end)
        if r.get("relation") in fixed.RELATIONS and all(ends):
            edges.append((ends[0], r["relation"], ends[1]))
    return nodes, edges


def records(n=60):
    rng = random.Random(4)
    words = ["Alpha", "alpha ", "Beta Corp", "beta corp holdings international group", "Gamma", "TSN Foods", "abc", "China", "PRC", "u.s.", "Supply chain disruption", "Supply", "", "Acme", "Acme Corp Europe"]
    types = ["RiskFactor", "RiskDriver", "RiskConsequence", "Mitigation", "BusinessSegment", "Product", "GeographicMarket", "CustomerSegment", "Competitor", "Regulation", "FinancialMetric", "Driver", "MacroFactor", "ManagementOutlook", "Unknown", None]
    for k in range(n):
        fields = ["title", "name", "description", "text", "label", "iso_code"]
        nodes = [{"type": rng.choice(types)} | {f: rng.choice(words) for f in fields if rng.random() < 0.5 and not (f == "iso_code" and rng.random() < 0.7)} for _ in range(rng.randint(0, 12))]
        relations = [{"relation": rng.choice([*list(fixed.RELATIONS)[:9], "NO_SUCH"]), "subject_title": rng.choice([*words, None]), "object_title": rng.choice(words)} for _ in range(rng.randint(0, 10))]
        yield f"{k % 7}", f"acc{k}", "mda", rng.choice(["Acme Corp", "ZETA INC"]), rng.choice([1992, 2001, 2020]), {"nodes": nodes, "relations": relations}


def test_against_the_plain_version(spark):
    rows = [(c, a, s, None, n, "10-K", None, y, 5, json.dumps(r) if k % 3 else f"Here: ```json\n{json.dumps(r)}\n```") for k, (c, a, s, n, y, r) in enumerate(records())]
    rows += [("5", "none", "mda", None, "Acme Corp", "10-K", None, 2020, 0, "no json"), ("5", "null", "mda", None, None, None, None, 2020, None, None)]
    docs = normalise.parsed(spark.createDataFrame(rows, META + ", raw string"))
    tickers = spark.createDataFrame(list(TICKERS.items()), "ticker string, cik string")
    nodes, edges = normalise.normalise(docs, tickers)
    got_nodes = {(r["seq"]["accession"], r["node_id"], r["label"]) for r in nodes.collect()}
    got_edges = sorted((r["filing_ref"], r["subject_id"], r["relation_type"], r["object_id"]) for r in edges.collect())
    want_nodes, want_edges = set(), []
    for c, a, s, n, y, r in [*records(), ("5", "none", "mda", "Acme Corp", 2020, {}), ("5", "null", "mda", "", 2020, {})]:
        own, e = plain(c, a, s, n, y, r)
        want_nodes |= {(a, k, v) for k, v in own.items()}
        want_edges += [(a, *x) for x in e]
    assert got_nodes == want_nodes
    assert got_edges == sorted(want_edges)
    merged = graph.merge_nodes(nodes, graph.NODE, "seq")
    assert merged.count() == len({(v, k) for _, k, v in want_nodes})


def test_properties_and_defaults(spark):
    record = {"nodes": [
        {"type": "RiskFactor", "description": "two words", "is_new": True}, {"type": "FinancialMetric", "name": "Net sales", "direction": "sideways", "basis": "non-GAAP", "value": 2.5},
        {"type": "MacroFactor", "name": "Rates", "direction": "headwind"}, {"type": "ManagementOutlook", "text": "Good", "sentiment": "glad", "horizon": "near_term"},
        {"type": "Mitigation", "description": "Hedge", "mitigation_type": "HEDGING"}, {"type": "Driver", "name": "Price"}, {"type": "GeographicMarket", "name": "Norway"},
    ]}
    rows = [("1", "a", "mda", "T", "Acme", "10-K", None, 2020, 9, json.dumps(record))]
    nodes, edges = normalise.normalise(normalise.parsed(spark.createDataFrame(rows, META + ", raw string")))
    n = {r["label"]: r for r in nodes.collect()}
    assert n["RiskFactor"]["name"] == "Untitled Risk" and n["RiskFactor"]["word_count"] == 2 and n["RiskFactor"]["is_new"] and n["RiskFactor"]["as_of_year"] == 2020
    assert (n["FinancialMetric"]["direction"], n["FinancialMetric"]["basis"], n["FinancialMetric"]["value"]) == ("not_stated", "non-GAAP", 2.5)
    assert n["MacroFactor"]["direction"] == "headwind" and (n["ManagementOutlook"]["sentiment"], n["ManagementOutlook"]["horizon"]) == ("neutral", "near_term")
    assert n["Mitigation"]["type"] == "hedging" and n["Driver"]["type"] == "revenue_driver" and n["GeographicMarket"]["node_id"] == "geo_norw" and n["GeographicMarket"]["level"] == "country"
    assert n["Company"]["ticker"] == "T" and n["Section"]["node_id"] == "1_a_mda"
    e = edges.where(F.col("relation_type") == "HAS_RISK").first()
    assert (e["confidence"], e["sentence_id"], e["filing_ref"], e["as_of_year"]) == (0.85, "a_mda_000", "a", 2020)


def test_empty(spark):
    docs = normalise.parsed(spark.createDataFrame([], META + ", raw string"))
    nodes, edges = normalise.normalise(docs)
    assert nodes.count() == 0 and edges.count() == 0


def test_mentions_are_made_inside_a_documents_row(spark):
    record = {"nodes": [{"type": "RiskFactor", "title": "A"}, {"type": "Competitor", "name": "Beta"}, {"type": "Other"}, {"type": "Competitor", "name": "beta"}, {"type": "RiskFactor", "title": "A"}]}
    docs = normalise.parsed(spark.createDataFrame([("1", "a", "mda", "T", "Acme", "10-K", None, 2020, 9, json.dumps(record))], META + ", raw string"))
    found = normalise.mentioned(docs)
    assert [(m["pos"], m["node_id"]) for m in found.first()["mentions"]] == [(0, "1_a_risk_0001"), (1, "comp_beta"), (4, "1_a_risk_0002")]
    nodes, edges = normalise.normalise(docs)
    for df in (found, nodes, edges):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_merged_by_subjects_rows_as_by_keys(spark):
    node = lambda **k: {f: k.get(f) for f in normalise.NODE}
    tells = lambda *r: dict(zip(normalise.RELATION, r))
    nodes = [node(type="RiskFactor", title="Flood"), node(type="RiskDriver", title="Rain"), node(type="RiskConsequence", name="Loss"), node(type="Competitor", name="TSN Foods"), node(type="FinancialMetric", name="Sales")]
    relations = [tells("Company", "Ann", "HAS_RISK", "RiskFactor", "flood"), tells("RiskFactor", "Flood", "CAUSED_BY", None, "rain"), tells("RiskDriver", "Rain", "MAY_RESULT_IN", None, "Loss"),
                 tells("RiskDriver", "rain", "MAY_RESULT_IN", None, "loss"), tells(None, "Ann", "COMPETES_WITH", None, "tsn foods"), tells(None, "Ann", "COMPETES_WITH", None, "nobody"), tells(None, "x", "unknown", None, "y")]
    rows = [(cik, acc, part, None, "Ann", None, None, year, 0, n, r)
            for cik, acc, part, year in [("1", "5", "a", 2001), ("1", "5", "b", 2001), ("1", "10", "a", 1800), ("5", "1", "a", 2002), ("2", "7", "a", None), (None, "8", "a", 2004)]
            for n, r in [(nodes, relations)]]
    rows += [("3", "9", "a", None, None, None, None, 2006, 0, None, relations), ("3", "9", "b", None, "Bob", None, None, 2006, 0, nodes, None), ("3", None, "b", None, "Bob", None, None, 2006, 0, [], [])]
    docs = spark.createDataFrame(rows, f"{META}, nodes {normalise.NODES_SCHEMA}, relations {normalise.RELATIONS_SCHEMA}")
    tickers = spark.createDataFrame(list(TICKERS.items()), "ticker string, cik string")
    for t in (None, tickers):
        writes = normalise.normalise(docs, t)[1]
        want = graph.merge_edges(writes.select(*graph.EDGE, "filing_ref", "as_of_year", "seq"), graph.EDGE, "seq").select(*graph.EDGE, "filing_ref", "as_of_year")
        merged = normalise.merged_edges(docs, t)
        assert sorted(map(tuple, merged.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and merged.schema == want.schema
    # rows of subjects are all that is shuffled, and one scan makes all edges
    plan = normalise.merged_edges(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan ExistingRDD") == 1
    assert writes._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
