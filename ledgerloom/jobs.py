"""What a user runs: batch jobs with their options, the service's functions, and the tables behind each page."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions import text
from ledgerloom.operators import chat, diff, entities, glossary, graph, names, noise, normalise, vectors
from ledgerloom.shared import stage
from ledgerloom.sources import filings, sinks
from ledgerloom.streaming import metrics

Extractor = Callable[[DataFrame], DataFrame]
DEFAULT_COMPANIES, MOST_COMPANIES = 300, 2000


# batch jobs


def run_preprocessing(spark: SparkSession, source: str, target: str, section: str, ticker_file: str | None = None, years: list[int] | None = None, limit: int | None = None, overwrite: bool = False) -> DataFrame:
    """Section files (or event files for section 8k) to section documents; files done before are skipped unless overwritten."""
    files = filings.event_files(spark, source) if section == "8k" else filings.section_files(spark, source)
    files = files.where(F.col("fiscal_year").isin(years)) if years else files
    files = files.orderBy("source_file").limit(limit) if limit else files
    table = filings.tickers(spark, ticker_file) if ticker_file else None
    return sinks.write_sections(filings.preprocessed(files, section, table), target, overwrite)


def run_glossary(documents: DataFrame, target: str) -> dict[str, DataFrame]:
    """The glossary of all sentences of section documents, written as a store."""
    s = filings.sentences(documents).select("cik", F.col("accession_number").alias("accession"), "section_type", "sentence_id", "section_id", "seq", "text")
    return sinks.write_glossary(glossary.mentions(s), target, "section_id", "seq")


def gazetteer_extractor(gazetteer: DataFrame) -> Extractor:
    """Extraction by rules and a gazetteer; one of several extractors, all of documents to cik, accession, section_type, nodes and relations."""

    def extract(documents: DataFrame) -> DataFrame:
        s = filings.sentences(documents).withColumnRenamed("accession_number", "accession")
        return entities.extracted(s, gazetteer)

    return extract


def learnt_extractor(gazetteer: DataFrame) -> Extractor:
    """Extraction by rules and a tagger that is fitted on the documents, as far as the gazetteer marks them."""

    def extract(documents: DataFrame) -> DataFrame:
        s = filings.sentences(documents).withColumnRenamed("accession_number", "accession")
        return entities.extracted(s, tagger=names.learn(s, gazetteer))

    return extract


def run_kg_population(documents: DataFrame, target: str, extractor: Extractor, tickers: DataFrame | None = None, section: str | None = None, limit: int | None = None, dry_run: bool = False, report: Callable[[dict], None] | None = None) -> DataFrame:
    """Extract, normalise and merge documents that the graph doesn't hold yet; the numbers of nodes and edges by kind.

    A document is done once its Section node is in the graph, so a job that stops is run again. A
    limit counts documents that aren't done. report gets documents, nodes, edges, seconds and
    rate of documents, counted while the rows are written.
    """
    began = time.monotonic()
    store = sinks.GraphStore(documents.sparkSession, target)
    d = documents.where(F.col("section_type") == section) if section else documents
    done = store.nodes()
    if done is not None:
        d = d.join(done.where("label = 'Section'").select(F.col("node_id").alias("section_id")), "section_id", "left_anti")
    d = d.orderBy("section_id").limit(limit) if limit else d
    meta = d.select(
        "metadata.cik", F.col("metadata.accession_number").alias("accession"), "section_type", "metadata.ticker", "metadata.company_name", "metadata.form_type",
        "metadata.filing_date", "metadata.fiscal_year", F.col("word_count").cast("long").alias("word_count"),
    )
    raw = stage(extractor(d), "records")
    whole = meta.join(raw, normalise.DOCUMENT, "left")
    whole, n_documents = metrics.observed(whole, documents=F.count("*"))
    parts = [metrics.observed(df, **{name: F.count("*")}) for df, name in zip(normalise.normalise(whole, tickers, "ner"), ("nodes", "edges"))]
    nodes, edges = (stage(df, name) for (df, _), name in zip(parts, ("nodes", "edges")))
    if not dry_run:
        store.write_documents(nodes, edges)
    if report:
        figures = n_documents.get | parts[0][1].get | parts[1][1].get
        report(metrics.report(figures, time.monotonic() - began, "documents"))
    return sinks.dry_run(nodes, edges)


def progress(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """total, done, percent and remaining of keys wanted."""
    both = wanted.select(key).distinct().join(done.select(key).distinct().withColumn("_done", F.lit(1)), key, "left")
    n, k = F.count("*"), F.count("_done")
    return both.agg(n.alias("total"), k.alias("done"), F.round(100 * k / F.greatest(n, F.lit(1)), 1).alias("percent"), (n - k).alias("remaining"))


def ingest_8k_events(spark: SparkSession, paths: list[str], target: str, companies: DataFrame) -> DataFrame:
    """Event tables to event nodes and edges, merged into the graph; tables without the needed columns are left out."""
    store, rows = sinks.GraphStore(spark, target), None
    for path in paths:
        table = filings.delimited(spark, path)
        if {"cik", "accession", "item_name", "date"} <= set(table.columns):
            own = filings.item_events(table)
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    if rows is not None:
        nodes, edges = filings.event_graph(rows, companies)
        store.upsert_nodes(nodes.withColumn("seq", F.lit(0)))
        store.upsert_edges(edges.withColumns({"filing_ref": F.lit(None).cast("string"), "seq": F.lit(0)}), valid=False)
    return store.nodes()


def clean_names(spark: SparkSession, target: str, label: str, execute: bool = False, **options) -> DataFrame:
    """The nodes of a label that a cleaning deletes; it is done only with execute."""
    store = sinks.GraphStore(spark, target)
    nodes, edges = store.nodes(), store.edges()
    rule = (lambda c: noise.NOISE[label](c, **options)) if options else None
    plan = noise.planned(nodes, label, rule)
    if execute:
        gone = plan.select("node_id", "name").cache()
        gone.count()
        store.replace(*noise.cleaned(nodes, edges, label, True, rule))
        return gone
    return plan.select("node_id", "name")


def main(argv: list[str] | None = None) -> None:
    """python -m ledgerloom.jobs preprocess|glossary|reindex ..."""
    from ledgerloom import build_session

    p = argparse.ArgumentParser(prog="ledgerloom.jobs")
    p.add_argument("job", choices=["preprocess", "glossary", "reindex"])
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--section", default="risk_factors", choices=fixed.SECTION_TYPES)
    p.add_argument("--tickers")
    p.add_argument("--years", type=int, nargs="*")
    p.add_argument("--limit", type=int)
    p.add_argument("--overwrite", action="store_true")
    a = p.parse_args(argv)
    spark = build_session()
    if a.job == "preprocess":
        run_preprocessing(spark, a.source, a.target, a.section, a.tickers, a.years, a.limit, a.overwrite)
    elif a.job == "glossary":
        run_glossary(sinks.Table(spark, a.source).read(), a.target)
    else:
        reindex(sinks.Index(spark, a.target), sinks.Table(spark, a.source).read())


# the service


def list_companies(companies: DataFrame, filed: DataFrame, q: str = "", limit: int = DEFAULT_COMPANIES, offset: int = 0) -> DataFrame:
    """cik, ticker, name, filing_count, latest_date and earliest_date of companies whose ticker or name holds q, ordered by ticker and cik.

    In q the signs % and _ are wildcards, as in LIKE.
    """
    if not 1 <= limit <= MOST_COMPANIES or offset < 0:
        raise ValueError(f"limit lies between 1 and {MOST_COMPANIES}, offset isn't negative")
    c = companies
    if q:
        like = f"%{q.upper()}%"
        c = c.where(F.upper("ticker").like(like) | F.upper("name").like(like))
    of = filed.groupBy("cik").agg(F.count("accession").alias("filing_count"), F.max("filing_date").alias("latest_date"), F.min("filing_date").alias("earliest_date"))
    out = c.join(of, "cik", "left").withColumn("filing_count", F.coalesce("filing_count", F.lit(0).cast("long")))
    return out.select("cik", "ticker", "name", "filing_count", "latest_date", "earliest_date").orderBy("ticker", "cik").offset(offset).limit(limit)


def company_filings(filed: DataFrame, cik: str | None = None) -> DataFrame:
    """Filings of a company, or of all, each with its place among its company's, the latest first, and the one before it."""
    rows = filed.where(F.col("cik") == cik) if cik is not None else filed
    place = Window.partitionBy("cik").orderBy(F.col("filing_date").desc(), F.col("accession").desc())
    return rows.withColumns({"recency": F.row_number().over(place), "previous": F.lead("accession").over(place)})


def get_filing(filed: DataFrame, accession: str) -> DataFrame:
    return filed.where(F.col("accession") == accession)


def delta(index: sinks.Index, sentences: DataFrame, latest: str, previous: str) -> DataFrame:
    """id and data of the payload between two filings: as kept before, or worked out and kept. Unknown filings have none."""
    key = f"{latest}|{previous}"
    found = index.find("deltas", key)
    if found is not None and not found.isEmpty():
        return found
    pairs = sentences.sparkSession.createDataFrame([(latest, previous)], "latest string, previous string")
    return sinks.cache_delta(index, diff.payload(pairs, index.read("filings"), sentences)).where(F.col("id") == key)


def reindex(index: sinks.Index, documents: DataFrame) -> dict[str, int]:
    """Clear the index and fill it from section documents; how many companies and filings it has then."""
    index.clear()
    for name, rows in zip(("companies", "filings"), filings.filing_index(documents)):
        index.replace_rows(name, rows)
    return health(index)


def health(index: sinks.Index) -> dict[str, int]:
    return {name: (t.count() if (t := index.read(name)) is not None else 0) for name in ("companies", "filings")}


# pages


def statistics_page(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Counts of nodes, edges, years, sections, companies, risk drivers, markets and competitors."""
    of = lambda r: edges.where(F.col("relation_type") == r)
    names = nodes.select("node_id", "name")
    top = lambda df, key, n, count: df.groupBy(key).agg(count.alias("n")).join(names, F.col(key) == F.col("node_id")).select("name", "n").orderBy(F.col("n").desc(), "name").limit(n)
    year = F.substring("object_id", 4, 9).cast("int")
    years = of("FILED_IN").groupBy(year.alias("year")).agg(F.count("*").alias("filings"))
    return {
        "nodes": nodes.groupBy("label").count().orderBy(F.col("count").desc(), "label"),
        "edges": edges.groupBy("relation_type").count().orderBy(F.col("count").desc(), "relation_type"),
        "years": years.orderBy("year"),
        "range": years.agg(F.min("year").alias("first"), F.max("year").alias("last")),
        "sections": nodes.where("label = 'Section'").groupBy("section_type").count().orderBy(F.col("count").desc(), "section_type"),
        "companies": top(of("FILED_BY"), "object_id", 15, F.count("*")),
        "risks": of("HAS_RISK").agg(F.count("*").alias("risks")),
        "risk_drivers": top(of("CAUSED_BY"), "object_id", 10, F.count("*")),
        "markets": top(of("OPERATES_IN"), "object_id", 15, F.countDistinct("subject_id")),
        "competitors": top(of("COMPETES_WITH"), "object_id", 15, F.countDistinct("subject_id")),
    }


def forward_looking(sentences: DataFrame, flag: Column, *keys: str) -> DataFrame:
    """keys, sentences, forward-looking ones and their share in percent."""
    n, k = F.count("*"), F.count_if(flag)
    return sentences.groupBy(*keys).agg(n.alias("sentences"), k.alias("forward"), F.round(100 * k / n, 1).alias("pct"))


def sentiment_page(by: DataFrame, least: int = 20, most: int = 20) -> dict[str, DataFrame]:
    """Totals, trend, ranks and histogram of by(company, year, sentences, forward, pct), as forward_looking() gives it."""
    enough = by.where(F.col("sentences") >= least)
    high = Window.partitionBy("year").orderBy(F.col("pct").desc(), "company")
    low = Window.partitionBy("year").orderBy("pct", F.col("company").desc())
    ranked = enough.withColumns({"from_top": F.row_number().over(high), "from_bottom": F.row_number().over(low)})
    s, k = F.sum("sentences"), F.sum("forward")
    span = enough.groupBy("year").agg(F.min("pct").alias("lo"), F.max("pct").alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo")) / 30, F.lit(1e-9))
    at = F.least(F.floor((F.col("pct") - F.col("lo")) / width), F.lit(29)).cast("int")
    return {
        "totals": by.agg(F.countDistinct("company").alias("companies"), F.countDistinct("year").alias("years"), F.sum("sentences").alias("sentences")),
        "trend": by.groupBy("year").agg(s.alias("sentences"), k.alias("forward"), F.round(100 * k / F.greatest(s, F.lit(1)), 1).alias("pct")).orderBy("year"),
        "top": ranked.where(F.col("from_top") <= most).select("year", "from_top", "company", "pct", "sentences"),
        "bottom": ranked.where(F.col("from_bottom") <= most).select("year", "from_bottom", "company", "pct", "sentences"),
        "histogram": enough.join(F.broadcast(span), "year").groupBy("year", at.alias("bin")).agg(F.count("*").alias("companies")),
    }


def company_trends(by: DataFrame) -> DataFrame:
    """company, mean, years of the highest and lowest share (the earliest of equals), first and last share and direction of by(company, year, pct)."""
    first, last = F.min_by("pct", "year"), F.max_by("pct", "year")
    n, tenths = F.count("pct"), F.sum(F.round(10 * F.col("pct")).cast("long"))
    mean = F.floor((2 * tenths + n) / (2 * n)) / 10  # halves up, in whole tenths
    return by.groupBy("company").agg(
        mean.alias("mean"), F.max_by("year", F.struct("pct", -F.col("year"))).alias("highest"), F.min_by("year", F.struct("pct", "year")).alias("lowest"),
        first.alias("first"), last.alias("latest"), F.when(last > first, "Up").otherwise("Down").alias("direction"),
    )


def coverage(filed: DataFrame) -> DataFrame:
    """cik, filings, earliest, latest and the list of fiscal years."""
    years = F.array_join(F.transform(F.array_sort(F.collect_set("fiscal_year")), lambda y: y.cast("string")), ", ")
    return filed.groupBy("cik").agg(F.count("*").alias("filings"), F.min("fiscal_year").alias("earliest"), F.max("fiscal_year").alias("latest"), years.alias("years"))


def comparison_page(filed: DataFrame, edges: DataFrame, by: DataFrame, selected: list[str]) -> dict[str, DataFrame]:
    """Coverage, years, shared and single markets and trends of selected companies."""
    own = filed.where(F.col("cik").isin(selected))
    markets = edges.where((F.col("relation_type") == "OPERATES_IN") & F.col("subject_id").isin(selected)).select("subject_id", "object_id").distinct()
    held = markets.groupBy("object_id").agg(F.count("*").alias("n"), F.min("subject_id").alias("cik"))
    return {
        "coverage": coverage(own),
        "years": own.groupBy("fiscal_year").pivot("cik", selected).agg(F.lit("Y")).orderBy("fiscal_year"),
        "markets": markets.groupBy("object_id").pivot("subject_id", selected).agg(F.lit("Yes")).orderBy("object_id"),
        "shared": held.where(F.col("n") == len(selected)).select(F.col("object_id").alias("market")),
        "single": held.where("n = 1").select("cik", F.col("object_id").alias("market")),
        "trends": company_trends(by.where(F.col("company").isin(selected))),
    }


def geography_page(nodes: DataFrame, edges: DataFrame, aliases: tuple[str, ...] = ("CHINA", "PRC", "PEOPLE'S REPUBLIC OF CHINA", "MAINLAND CHINA")) -> dict[str, DataFrame]:
    """Companies a market with its code and kind, and companies in any of the markets of some aliases."""
    m = nodes.where("label = 'GeographicMarket'").select(F.col("node_id").alias("object_id"), F.col("name").alias("market"))
    rows = edges.where("relation_type = 'OPERATES_IN'").join(m, "object_id")
    counts = rows.groupBy("market").agg(F.countDistinct("subject_id").alias("companies"))
    return {
        "markets": counts.withColumns({"code": text.country_code(F.col("market")), "kind": text.market_kind(F.col("market"))}).orderBy(F.col("companies").desc(), "market"),
        "exposed": rows.where(F.upper(F.trim("market")).isin(*aliases)).select(F.col("subject_id").alias("cik")).distinct(),
    }


def profile_page(nodes: DataFrame, edges: DataFrame, filed: DataFrame, store: DataFrame, cik: str) -> dict[str, DataFrame]:
    """Filings, markets, competitors, risks and sentences of a company."""
    risk = graph.branches(edges, edges.where((F.col("subject_id") == cik) & (F.col("relation_type") == "HAS_RISK")).select(F.col("object_id").alias("risk")), "risk",
                          drivers="CAUSED_BY", consequences="MAY_RESULT_IN", mitigations="MITIGATED_BY")
    return {
        "filings": company_filings(filed, cik),
        "years": filed.where(F.col("cik") == cik).groupBy("fiscal_year").agg(F.count("*").alias("filings")),
        "markets": graph.neighbours(edges, cik, "OPERATES_IN"),
        "competitors": graph.neighbours(edges, cik, "COMPETES_WITH"),
        "risks": risk.join(nodes.select(F.col("node_id").alias("risk"), "name", "description"), "risk", "left"),
        "sentences": vectors.fetched(store, {"cik": {"$eq": cik}}, 20),
    }


def status_page(companies: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """fiscal_year, a count of filings for each section table(cik, fiscal_year) and Complete, Partial or Missing, latest year first.

    A year is complete where all sections have filings of all companies' number or more.
    """
    whole = companies.select("cik").distinct().count()
    out = None
    for name, df in sections.items():
        own = df.groupBy("fiscal_year").agg(F.countDistinct("cik").alias(name))
        out = own if out is None else out.join(own, "fiscal_year", "full")
    counts = [F.coalesce(F.col(n), F.lit(0).cast("long")) for n in sections]
    state = F.when(F.least(*counts) >= whole if len(counts) > 1 else counts[0] >= whole, "Complete").when(F.greatest(*counts) > 0 if len(counts) > 1 else counts[0] > 0, "Partial").otherwise("Missing")
    return out.select("fiscal_year", *[c.alias(n) for c, n in zip(counts, sections)], state.alias("status")).orderBy(F.col("fiscal_year").desc())


def chat_page(turns: DataFrame) -> DataFrame:
    """Each turn's window and the history text of a prompt, for turns(conversation, turn, question, answer)."""
    held = chat.windows(turns, "conversation", "turn", "question", "answer")
    return held.withColumn("history", chat.history(F.col("turns")))


if __name__ == "__main__":
    main()
