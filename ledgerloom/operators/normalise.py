"""From raw extraction records to a typed graph of nodes and edges.

A document is a row with its metadata and two arrays, nodes and relations, as an extractor gives
them. Rules are declared once for each type; documents are independent of one another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions import text
from ledgerloom.shared import stage

#: Fields of raw nodes and relations, all text but where given otherwise; documents may lack some.
NODE = {
    "type": "string", "title": "string", "name": "string", "description": "string", "category": "string", "is_new": "boolean", "segment_type": "string",
    "iso_code": "string", "revenue_pct": "double", "value": "double", "unit": "string", "direction": "string", "basis": "string", "yoy_change": "double",
    "sentiment": "string", "horizon": "string", "driver_type": "string", "text": "string", "level": "string", "label": "string", "body": "string",
    "jurisdiction": "string", "mitigation_type": "string",
}
RELATION = ["subject_type", "subject_title", "relation", "object_type", "object_title"]
DOCUMENT = ["cik", "accession", "section_type"]
META = [*DOCUMENT, "ticker", "company_name", "form_type", "filing_date", "fiscal_year", "word_count"]
NODES_SCHEMA = f"array<struct<{', '.join(f'{k}: {v}' for k, v in NODE.items())}>>"
RELATIONS_SCHEMA = f"array<struct<{', '.join(f'{k}: string' for k in RELATION)}>>"
#: Properties of typed nodes; those that a label lacks are null.
PROPERTIES = {
    "name": "string", "description": "string", "category": "string", "is_new": "boolean", "word_count": "long", "as_of_year": "long", "cik": "string",
    "accession": "string", "ticker": "string", "form_type": "string", "filing_date": "date", "section_type": "string", "segment_type": "string",
    "revenue_pct": "double", "iso_code": "string", "level": "string", "value": "double", "unit": "string", "direction": "string", "basis": "string",
    "yoy_change": "double", "sentiment": "string", "horizon": "string", "type": "string", "body": "string", "jurisdiction": "string",
}


def parsed(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """Documents whose record is JSON text, with nodes and relations parsed from the first object in it."""
    record = F.from_json(text.first_object(F.col(raw)), f"struct<nodes: {NODES_SCHEMA}, relations: {RELATIONS_SCHEMA}>")
    return documents.withColumn("_r", record).select("*", "_r.nodes", "_r.relations").drop("_r", raw)


def _or(*options: Column | str) -> Column:
    """The first option that is neither null nor empty; the last is a default."""
    *some, last = [F.lit(o) if isinstance(o, str) else o for o in options]
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in some], last)


#: Types whose nodes are numbered in their document.
NUMBERED = ["RiskFactor", "Mitigation", "ManagementOutlook"]


def _rivals(documents: DataFrame, tickers: DataFrame) -> DataFrame:
    """Documents, staged, with rivals: a map from the tickers that begin their competitors' names to ciks."""
    documents = stage(documents.withColumn("_row", F.monotonically_increasing_id()), "records")
    known = tickers.select(F.upper("ticker").alias("_ticker"), text.cik(F.col("cik")).alias("_cik")).groupBy("_ticker").agg(F.max("_cik").alias("_cik"))
    named = F.transform(F.filter("nodes", lambda n: n["type"] == "Competitor"), _ticker)
    found = documents.select("_row", F.explode(F.array_distinct(named)).alias("_ticker")).join(known, "_ticker")
    found = found.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_ticker", "_cik"))).alias("rivals"))
    return documents.join(found, "_row", "left").drop("_row")


def _ticker(n: Column) -> Column:
    """The first word of a node's name."""
    return F.get(F.split(F.upper(F.trim(n["name"])), r"\s+"), F.lit(0))


def mentioned(documents: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Documents with mentions: an array, in order, of the first mention of each node of a known type.

    A mention has pos (the raw node's place), label, node_id, key (its name in the index) and rival_cik.
    tickers(ticker, cik) resolves competitors by the first word of their name. All is done inside a
    document's row, so nothing is shuffled but tickers.
    """
    if tickers is not None:
        documents = _rivals(documents, tickers)
    # lets, as what is referred to in a lambda would be found again for each node
    places = F.struct(*(F.array_compact(F.transform("nodes", lambda n, i: F.when(n["type"] == t, i))).alias(t) for t in NUMBERED))  # noqa: B023
    nothing = F.lit(None).cast("string")

    def one(n: Column, i: Column, at: Column) -> Column:
        seq = F.coalesce(*[F.when(n["type"] == t, F.array_position(at[t], i)) for t in NUMBERED])
        rival = F.when(n["type"] == "Competitor", F.col("rivals")[_ticker(n)]) if tickers is not None else nothing
        rules = _rules(n, seq, rival)
        pick = lambda k: reduce(lambda c, t: c.when(n["type"] == t, rules[t][k]), rules, F)
        return F.struct(i.alias("pos"), n["type"].alias("label"), pick(0).alias("node_id"), pick(1).alias("key"), rival.alias("rival_cik"))

    # a node without an identifier is one of its own
    known = text.let(places, lambda at: F.filter(F.transform("nodes", lambda n, i: one(n, i, at)), lambda m: m["label"].isin(*TYPES)))
    name = lambda m: F.coalesce(m["node_id"], F.lit("\0"))
    first = text.let(known, lambda ms: text.let(F.transform(ms, name), lambda ids: F.filter(ms, lambda m, i: F.array_position(ids, name(m)) == i + 1)))
    return documents.withColumn("mentions", first).drop("rivals")


#: Types that are known.
TYPES = [
    "RiskFactor", "RiskDriver", "RiskConsequence", "Mitigation", "BusinessSegment", "Product", "GeographicMarket", "CustomerSegment", "Competitor", "Regulation",
    "FinancialMetric", "Driver", "MacroFactor", "ManagementOutlook",
]


def _rules(n: Column, seq: Column, rival_cik: Column) -> dict[str, tuple[Column, Column, Column]]:
    """For each type: identifier, name in the index, name shown."""
    cik, accession, year = F.col("cik").cast("string"), F.col("accession").cast("string"), F.col("fiscal_year")
    of = lambda prefix, name: F.concat(F.lit(prefix), text.slugify(name))
    in_year = lambda kind, name: F.concat(F.format_string(f"%s_%d_{kind}_", cik, year), text.slugify(name))
    plain = lambda default: F.coalesce(n["name"], F.lit(default))

    risk = F.coalesce(n["title"], F.lit("Untitled Risk"))
    driver, consequence = _or(n["title"], n["name"], "Unknown Driver"), _or(n["title"], n["name"], "Unknown Consequence")
    mitigation = _or(n["description"], n["title"], "")
    iso = _iso(n)
    segment = _or(n["name"], n["label"], "Unknown")
    outlook = _or(n["text"], n["name"], n["description"], "")
    mitigation_id = F.format_string("mit_%s_%s_%04d", cik, accession, seq)
    rival = plain("Unknown Competitor")
    return {
        "RiskFactor": (F.format_string("%s_%s_risk_%04d", cik, accession, seq), F.lower(risk), risk),
        "RiskDriver": (of("rd_", driver), F.lower(driver), driver),
        "RiskConsequence": (of("rc_", consequence), F.lower(consequence), consequence),
        "Mitigation": (mitigation_id, F.substring(F.lower(_or(mitigation, mitigation_id)), 1, 60), mitigation),
        "BusinessSegment": (in_year("seg", plain("Unknown Segment")), F.lower(plain("Unknown Segment")), plain("Unknown Segment")),
        "Product": (in_year("prod", plain("Unknown Product")), F.lower(plain("Unknown Product")), plain("Unknown Product")),
        "GeographicMarket": (F.concat(F.lit("geo_"), F.lower(iso)), F.lower(plain("")), _or(n["name"], iso)),
        "CustomerSegment": (of("cs_", segment), F.lower(segment), segment),
        "Competitor": (F.coalesce(F.concat(F.lit("comp_"), rival_cik), of("comp_", rival)), F.lower(rival), rival),
        "Regulation": (of("reg_", plain("Unknown Regulation")), F.lower(plain("Unknown Regulation")), plain("Unknown Regulation")),
        "FinancialMetric": (F.concat(cik, F.lit("_"), accession, F.lit("_metric_"), text.slugify(plain("Unknown Metric"))), F.lower(plain("Unknown Metric")), plain("Unknown Metric")),
        "Driver": (of("drv_", plain("Unknown Driver")), F.lower(plain("Unknown Driver")), plain("Unknown Driver")),
        "MacroFactor": (of("macro_", plain("Unknown Factor")), F.lower(plain("Unknown Factor")), plain("Unknown Factor")),
        "ManagementOutlook": (F.format_string("%s_%s_outlook_%04d", cik, accession, seq), F.lower(F.substring(outlook, 1, 40)), outlook),
    }


def _iso(n: Column) -> Column:
    return _or(n["iso_code"], text.market_code(F.coalesce(n["name"], F.lit(""))))


def typed_nodes(mentions: DataFrame) -> DataFrame:
    """A row each of mentioned()'s mentions: document columns, pos, label, node_id, key, properties."""
    d = mentions.select(*META, F.explode(F.transform("mentions", lambda m: F.struct(m.alias("m"), F.get("nodes", m["pos"]).alias("n")))).alias("x")).select(*META, "x.m.*", "x.n")
    n = {k: F.col(f"n.{k}") for k in NODE}
    own = [F.col(c).cast("string") for c in DOCUMENT]
    cik, accession, year, iso = own[0], own[1], F.col("fiscal_year"), _iso(n)
    shown = {t: r[2] for t, r in _rules(n, F.lit(None), F.col("rival_cik")).items()}
    only = lambda value, *types: F.when(n["type"].isin(*types), value)
    described = F.coalesce(n["description"], F.lit(""))
    filed = ("RiskFactor", "Mitigation", "FinancialMetric", "ManagementOutlook")
    props = {
        "name": F.coalesce(*[F.when(n["type"] == t, c) for t, c in shown.items()]),
        "description": F.when(n["type"] == "RiskFactor", described).otherwise(only(n["description"], "BusinessSegment")),
        "category": only(n["category"], "RiskFactor", "Product"),
        "is_new": only(F.coalesce(n["is_new"], F.lit(False)), "RiskFactor"),
        "word_count": only(text.word_count(described), "RiskFactor"),
        "as_of_year": only(year.cast("long"), "RiskFactor", "BusinessSegment", "Product", "FinancialMetric"),
        "cik": F.when(n["type"].isin(*filed, "BusinessSegment", "Product"), cik).otherwise(only(F.col("rival_cik"), "Competitor")),
        "accession": only(accession, *filed),
        "segment_type": only(n["segment_type"], "BusinessSegment"),
        "revenue_pct": only(n["revenue_pct"], "BusinessSegment"),
        "iso_code": only(iso, "GeographicMarket"),
        "level": only(F.coalesce(n["level"], F.lit("country")), "GeographicMarket"),
        "value": only(n["value"], "FinancialMetric"),
        "unit": only(n["unit"], "FinancialMetric"),
        "direction": F.when(n["type"] == "MacroFactor", text.coerced(n["direction"], fixed.MACRO_DIRECTIONS, "neutral")).otherwise(
            only(text.coerced(n["direction"], fixed.DIRECTIONS, "not_stated"), "FinancialMetric")
        ),
        "basis": only(text.coerced(n["basis"], fixed.BASES, "GAAP"), "FinancialMetric"),
        "yoy_change": only(n["yoy_change"], "FinancialMetric"),
        "sentiment": only(text.coerced(n["sentiment"], fixed.SENTIMENTS, "neutral"), "ManagementOutlook"),
        "horizon": only(text.coerced(n["horizon"], fixed.HORIZONS, "full_year"), "ManagementOutlook"),
        "type": F.when(n["type"] == "Mitigation", text.coerced(F.lower(n["mitigation_type"]), fixed.MITIGATION_TYPES, "other")).otherwise(
            only(text.coerced(n["driver_type"], fixed.DRIVER_TYPES, "revenue_driver"), "Driver")
        ),
        "body": only(n["body"], "Regulation"),
        "jurisdiction": only(n["jurisdiction"], "Regulation"),
    }
    missing = {k: F.lit(None).cast(v) for k, v in PROPERTIES.items() if k not in props}
    return d.select(
        *[c.alias(f"_{k}") for k, c in zip(DOCUMENT, own)], F.col("fiscal_year").alias("_year"), "pos", "label", "node_id", "key",
        *[(props | missing)[k].cast(v).alias(k) for k, v in PROPERTIES.items()],
    )


def base_nodes(documents: DataFrame) -> DataFrame:
    """The Company, Filing and Section node of each document."""
    d = documents.select([c for c in documents.columns if c in META])
    s = lambda c: F.col(c).cast("string")
    kinds = {
        "Company": (s("cik"), {"cik": s("cik"), "ticker": F.col("ticker"), "name": F.col("company_name")}),
        "Filing": (s("accession"), {"accession": s("accession"), "form_type": F.col("form_type"), "filing_date": F.col("filing_date"), "cik": s("cik")}),
        "Section": (text.section_id(F.col("cik"), F.col("accession"), F.col("section_type")), {"section_type": F.col("section_type"), "word_count": F.col("word_count"), "accession": s("accession")}),
    }
    parts = [
        d.select(node_id.alias("node_id"), F.lit(label).alias("label"), *[props.get(k, F.lit(None)).cast(v).alias(k) for k, v in PROPERTIES.items()], s("accession").alias("_order"), F.lit(-1).alias("pos"))
        for label, (node_id, props) in kinds.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def resolved(mentions: DataFrame) -> DataFrame:
    """Relations of mentioned() with both ends resolved: document columns, pos, subject_id, relation_type, object_id.

    A name is the node of that name in its document; or the company where one name holds the other;
    or the first node in order whose name starts with the name's first 20 characters. Relations of
    unknown type or with an end that stays open are dropped.
    """
    rel = _ends(mentions).select("_cik", "_accession", "_section_type", "_year", F.posexplode("found").alias("pos", "r"))
    return rel.select("_cik", "_accession", "_section_type", "_year", "pos", "r.*").where("subject_id IS NOT NULL AND object_id IS NOT NULL")


def _ends(mentions: DataFrame) -> DataFrame:
    """Document columns, mentions, and found: the relations of known type in order, with the ends that are resolved."""
    doc = ["_cik", "_accession", "_section_type"]
    m = mentions.select(
        *[F.col(c).cast("string").alias(f"_{c}") for c in DOCUMENT], F.lower(F.coalesce("company_name", F.lit(""))).alias("company"), F.col("fiscal_year").alias("_year"),
        F.coalesce(F.filter("relations", lambda r: r["relation"].isin(*fixed.RELATIONS)), F.array()).alias("relations"), F.col("mentions.key").alias("_keys"), F.col("mentions.node_id").alias("_ids"), "mentions",
    )
    # the company comes before all nodes; of equal names the last counts
    d = m.withColumns({"keys": F.concat(F.array("company"), F.coalesce("_keys", F.array())), "node_ids": F.concat(F.array("_cik"), F.coalesce("_ids", F.array()))})
    last = F.reverse(F.zip_with("keys", "node_ids", lambda k, i: F.when(i.isNotNull(), k)))
    d = d.withColumns({"last_keys": last, "last_ids": F.reverse("node_ids")})
    of = lambda name: F.get("last_ids", F.array_position("last_keys", name).cast("int") - 1)

    def found(name: Column) -> Column:
        by_company = F.when(F.col("company").contains(name) | name.contains(F.col("company")), F.col("_cik"))
        near = F.get(F.filter("keys", lambda k: (F.substring(k, 1, 1) == F.substring(name, 1, 1)) & k.startswith(F.substring(name, 1, 20))), F.lit(0))
        return F.when(name != "", F.coalesce(of(name), by_company, text.let(near, of)))

    end = lambda r, e: F.lower(F.coalesce(r[f"{e}_title"], F.lit("")))
    # each different name once
    names = F.array_distinct(F.flatten(F.transform("relations", lambda r: F.array(end(r, "subject"), end(r, "object")))))
    d = d.withColumn("names", names).withColumn("ids", F.transform("names", found))
    id_of = lambda r, e: F.get(F.col("ids"), F.array_position("names", end(r, e)).cast("int") - 1)
    found = F.transform("relations", lambda r: F.struct(id_of(r, "subject").alias("subject_id"), r["relation"].alias("relation_type"), id_of(r, "object").alias("object_id")))
    return d.select(*doc, "_year", "mentions", found.alias("found"))


def _whole(documents: DataFrame) -> DataFrame:
    """Documents with nodes and relations, null where they are absent."""
    items = [c for c in ("nodes", "relations") if c in documents.columns]
    absent = {c: F.lit(None).cast(t) for c, t in (("nodes", NODES_SCHEMA), ("relations", RELATIONS_SCHEMA)) if c not in items}
    return documents.select(*META, *items).withColumns(absent)


def _written(mentions: DataFrame) -> DataFrame:
    """Document columns and writes: an array of pos, subject_id, relation_type and object_id of a document's edges, made inside its row."""
    d = _ends(mentions)
    cik, accession, year = F.col("_cik"), F.col("_accession"), F.col("_year")
    write = lambda a, r, b, pos=F.lit(-1): F.struct(pos.cast("int").alias("pos"), a.alias("subject_id"), r.alias("relation_type"), b.alias("object_id"))
    own = F.array_compact(F.array(
        write(accession, F.lit("FILED_BY"), cik), write(accession, F.lit("HAS_SECTION"), text.section_id(cik, accession, F.col("_section_type"))),
        F.when(year.between(fixed.FIRST_YEAR, fixed.LAST_YEAR), write(accession, F.lit("FILED_IN"), F.format_string("fy_%d", year))),
    ))
    relation = lambda m: reduce(lambda c, x: c.when(m["label"] == x[0], x[1]), IMPLIED.items(), F)
    implied = F.transform(F.filter("mentions", lambda m: m["label"].isin(*IMPLIED)), lambda m: write(cik, relation(m), m["node_id"], m["pos"]))
    told = F.transform("found", lambda r, i: write(r["subject_id"], r["relation_type"], r["object_id"], i + 1_000_000))
    told = F.filter(told, lambda w: w["subject_id"].isNotNull() & w["object_id"].isNotNull())
    return d.select("_cik", "_accession", "_section_type", "_year", F.concat(own, F.coalesce(implied, F.array()), told).alias("writes"))


#: Relations of a company to nodes of a label, whether the record tells them or not.
IMPLIED = {"RiskFactor": "HAS_RISK", "FinancialMetric": "REPORTS", "ManagementOutlook": "HAS_OUTLOOK"}
#: Relations that start at a company or its filing, whose edges are as many as its filings make; those of other subjects are dealt to DEALS parts.
OWNED, DEALS = ["FILED_BY", "HAS_SECTION", "FILED_IN", *(r for r, (label, _) in fixed.RELATIONS.items() if label in ("Company", "Filing"))], 64


def merged_edges(documents: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """The edges of normalise(), one each key triple, with the filing_ref and as_of_year of its last write.

    A document's edges go to their subject's task as one row for each subject, so its filing and the
    subject aren't shuffled with every edge, and nothing is staged.
    """
    deal = lambda w: F.when(w["relation_type"].isin(*OWNED), F.lit(0)).otherwise(F.pmod(F.xxhash64(w["object_id"]), F.lit(DEALS))).cast("int")
    home = lambda w: F.struct(w["subject_id"].alias("subject_id"), deal(w).alias("deal"))
    d = _written(mentioned(_whole(documents), tickers)).select("_accession", "_year", "writes").withColumn("homes", F.array_distinct(F.transform("writes", home)))
    edges = lambda h: F.transform(F.filter("writes", lambda w: home(w).eqNullSafe(h)), lambda w: F.struct(w["relation_type"].alias("relation_type"), w["object_id"].alias("object_id"), w["pos"].alias("pos")))
    rows = d.select("_accession", "_year", F.explode(F.transform("homes", lambda h: F.struct(h.alias("h"), edges(h).alias("edges")))).alias("x"))
    rows = rows.select("x.h.*", "_accession", "_year", "x.edges").repartition("subject_id", "deal")
    writes = rows.select("subject_id", "deal", "_accession", "_year", F.explode("edges").alias("e")).select("subject_id", "deal", "e.*", "_accession", "_year")
    last = writes.groupBy("subject_id", "deal", "relation_type", "object_id").agg(F.max(F.struct("_accession", "pos", "_year")).alias("l"))
    return last.select("subject_id", "relation_type", "object_id", F.col("l._accession").alias("filing_ref"), F.col("l._year").cast("long").alias("as_of_year"))


def normalise(documents: DataFrame, tickers: DataFrame | None = None, method: str = "llm") -> tuple[DataFrame, DataFrame]:
    """Writes of nodes and edges of all documents, to be merged by graph.merge_nodes and graph.merge_edges.

    Nodes: node_id, label, the properties, seq. Edges: subject_id, relation_type, object_id,
    as_of_year, filing_ref, confidence, sentence_id, method, weight, seq. seq orders writes by
    accession and place. Null arrays have no items; raw types and relations that aren't known are
    ignored; FILED_IN is made for years of the chain alone.
    """
    documents = stage(mentioned(_whole(documents), tickers), "mentions")  # read by all branches below
    first = typed_nodes(documents)
    order = lambda a, pos: F.struct(F.col(a).alias("accession"), F.col(pos).cast("int").alias("pos")).alias("seq")
    props = ["node_id", "label", *PROPERTIES]
    nodes = base_nodes(documents).select(*props, order("_order", "pos")).unionByName(first.select(*props, order("_accession", "pos")))

    edges = _written(documents).select("_accession", "_section_type", "_year", F.explode("writes").alias("w")).select("_accession", "_section_type", "_year", "w.*")
    return nodes, edges.select(
        "subject_id", "relation_type", "object_id", F.col("_year").cast("long").alias("as_of_year"), F.col("_accession").alias("filing_ref"),
        F.lit(fixed.CONFIDENCE).alias("confidence"), F.format_string("%s_%s_000", "_accession", "_section_type").alias("sentence_id"),
        F.lit(method).alias("method"), F.lit(1.0).alias("weight"), order("_accession", "pos"),
    )
