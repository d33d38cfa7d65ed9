"""Questions over the graph and the filings: routing, company names, context, guards and the lines of an answer.

What a language model does is left to a callable of the caller; all else is declared here.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions import text
from ledgerloom.shared import stage

ROUTING = "struct<intent: string, company: string, cik: string, years: array<int>, topic: string, cypher_hint: string>"
#: Terms that go to all tasks at most; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
EXECUTED, SHOWN, TURNS, RECENT = 50, 30, 8, 4


def primary_source(question: Column, topic: Column | None = None, semantic: list[str] = fixed.SEMANTIC_SIGNALS, graph: list[str] = fixed.GRAPH_SIGNALS) -> Column:
    """semantic where more of its signals are in the question or topic than of the graph's, else graph."""
    q, t = F.lower(question), F.lower(F.coalesce(topic, F.lit(""))) if topic is not None else F.lit("")
    n = lambda signals: sum(((q.contains(s) | t.contains(s)).cast("int") for s in signals), F.lit(0))
    return F.when(n(semantic) > n(graph), "semantic").otherwise("graph")


def routing(answer: Column) -> Column:
    """The routing in a model's answer, from the first object in it, or the default record."""
    default = F.struct(
        F.lit("company").alias("intent"), *[F.lit(None).cast("string").alias(c) for c in ("company", "cik")], F.lit(None).cast("array<int>").alias("years"),
        F.lit(None).cast("string").alias("topic"), F.lit("general company query").alias("cypher_hint"),
    )
    return F.coalesce(F.from_json(text.first_object(answer), ROUTING), default)


def resolved_companies(terms: DataFrame, companies: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """term, cik and name of the company that each of terms(term, cik) means; unresolved terms keep their cik.

    A known cik wins; then a ticker or a name that holds the term, shortest name first, ties by cik.
    tickers(ticker, cik) gives a cik to terms that are tickers. Terms may be many: each name gives its
    substrings of the terms' lengths, and those meet the terms by equal hashes.
    """
    asked = terms.select("term", F.col("cik").cast("string").alias("cik")).distinct()
    if tickers is not None:
        own = tickers.select(F.upper("ticker").alias("_t"), text.cik(F.col("cik")).alias("_cik")).groupBy("_t").agg(F.max("_cik").alias("_cik"))
        asked = asked.join(own, F.upper(F.trim("term")) == F.col("_t"), "left").select("term", F.coalesce("_cik", "cik").alias("cik"))
    c = companies.select(F.col("cik").cast("string").alias("found"), "ticker", "name")
    exact = asked.where("cik IS NOT NULL").join(c, F.col("cik") == F.col("found")).select("term", "cik", "found", "name", F.lit(0).alias("stage"))
    words = stage(asked.select("term", "cik", F.lower("term").alias("_low")).where("term IS NOT NULL"), "terms")
    # names are small files whose substrings are many
    lower = c.withColumn("_name", F.lower("name")).repartition(int(c.sparkSession.conf.get("spark.sql.shuffle.partitions")), "found")
    longest = lower.agg(F.max(F.length("_name"))).first()[0]
    # no more lengths than the longest name has characters
    sizes = [r[0] for r in words.select(F.length("_low").alias("n")).where(F.col("n") <= F.lit(longest)).distinct().collect()]
    at = F.expr("sequence(1, if(_n = 0, 1, length(_name) - _n + 1))")
    parts = lower.withColumn("_n", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).where("length(_name) >= _n").withColumn("_at", F.explode(at))
    part = parts.select("found", "name", "_name", F.xxhash64(F.substr("_name", F.col("_at"), F.col("_n"))).alias("_h"))
    hashed = words.withColumn("_h", F.xxhash64("_low"))
    hashed = F.broadcast(hashed) if words.count() <= BROADCAST_TERMS else hashed.hint("merge")
    held = part.join(hashed, "_h").where(F.contains("_name", F.col("_low")))
    own = c.withColumn("_low", F.lower("ticker")).join(words, "_low")
    like = held.select("term", "cik", "found", "name").unionByName(own.select("term", "cik", "found", "name")).withColumn("stage", F.lit(1))
    best = exact.unionByName(like).groupBy("term", "cik").agg(F.min(F.struct("stage", F.length("name").alias("size"), "found", "name")).alias("b"))
    given = asked.withColumnRenamed("cik", "_own").join(best.withColumnRenamed("term", "_term"), (F.col("term") == F.col("_term")) & F.col("_own").eqNullSafe(F.col("cik")), "left")
    return given.select("term", F.coalesce("b.found", "_own").alias("cik"), F.col("b.name").alias("name"))


def carried(turns: DataFrame, conversation: str, order: str) -> DataFrame:
    """Turns(conversation, order, routing fields) with company, cik, years and topic filled from the last turn that had them."""
    before = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    years = F.when(F.size("years") == 2, F.col("years"))
    given = {"company": F.nullif("company", F.lit("")), "cik": F.nullif("cik", F.lit("")), "years": years, "topic": F.nullif("topic", F.lit(""))}
    return turns.withColumns({k: F.last(v, True).over(before) for k, v in given.items()})


def windows(turns: DataFrame, conversation: str, order: str, *columns: str, size: int = TURNS) -> DataFrame:
    """Each turn with its conversation's last turns, itself included, as an array of structs."""
    frame = Window.partitionBy(conversation).orderBy(order).rowsBetween(1 - size, Window.currentRow)
    return turns.select(conversation, order, F.collect_list(F.struct(*columns)).over(frame).alias("turns"))


def history(turns: Column) -> Column:
    """The last four turns(question, answer) of an array as text for a prompt; answers are cut at 300 characters."""
    line = lambda t: F.concat(F.lit("Q: "), t["question"], F.lit("\nA: "), F.substring(t["answer"], 1, 300), F.when(F.length(t["answer"]) > 300, "...").otherwise(""))
    recent = F.slice(turns, F.greatest(F.size(turns) - RECENT + 1, F.lit(1)), RECENT)
    return F.when(F.size(turns) == 0, "(no previous turns)").otherwise(F.array_join(F.transform(recent, line), "\n"))


def is_read_only(query: str) -> bool:
    """Whether a query only reads: none of the words that change data, and SELECT, WITH or FROM at its start."""
    bare = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", query, flags=re.S)
    return not re.search(fixed.FORBIDDEN_QUERY, bare) and not re.search(fixed.FORBIDDEN_SQL, bare) and bool(re.match(r"(?i)^\s*(SELECT|WITH|FROM)\b", bare)) and ";" not in bare.rstrip().rstrip(";")


def ask(spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None, most: int | None = None, **params) -> DataFrame:
    """The rows of a read-only query with parameters over tables in braces."""
    if not is_read_only(query):
        raise ValueError("only queries that read are allowed")
    rows = spark.sql(query, args=params or None, **(tables or {}))
    return rows if most is None else rows.limit(most)


#: Queries by intent over tables companies, filings, edges, nodes; each takes parameters.
TEMPLATES = {
    "markets_of": "SELECT c.name AS company, array_sort(collect_set(n.name)) AS markets FROM {companies} c JOIN {edges} e ON e.subject_id = c.cik AND e.relation_type = 'OPERATES_IN' JOIN {nodes} n ON n.node_id = e.object_id WHERE c.cik = :cik GROUP BY c.name",
    "exposed_to": "SELECT c.name AS company, c.ticker, array_sort(collect_set(n.name)) AS markets FROM {companies} c JOIN {edges} e ON e.subject_id = c.cik AND e.relation_type = 'OPERATES_IN' JOIN {nodes} n ON n.node_id = e.object_id WHERE contains(lower(n.name), lower(:market)) GROUP BY c.name, c.ticker ORDER BY company LIMIT 50",
    "outlooks": "SELECT f.fiscal_year AS year, n.sentiment, n.name AS outlook FROM {edges} e JOIN {nodes} n ON n.node_id = e.object_id JOIN {filings} f ON f.accession = n.accession WHERE e.relation_type = 'HAS_OUTLOOK' AND e.subject_id = :cik AND f.fiscal_year BETWEEN :first AND :last ORDER BY year DESC, outlook LIMIT 50",
    "available_years": "SELECT c.name AS company, array_sort(collect_set(f.fiscal_year)) AS available_years FROM {companies} c JOIN {filings} f ON f.cik = c.cik WHERE c.cik = :cik GROUP BY c.name",
    "filing_counts": "SELECT c.name AS company, c.ticker, count(*) AS filing_count FROM {companies} c JOIN {filings} f ON f.cik = c.cik GROUP BY c.name, c.ticker ORDER BY filing_count DESC, company LIMIT 30",
    "competitors_of": "SELECT n.name AS competitor, count(*) AS mentions FROM {edges} e JOIN {nodes} n ON n.node_id = e.object_id WHERE e.relation_type = 'COMPETES_WITH' AND e.subject_id = :cik GROUP BY n.name ORDER BY mentions DESC, competitor LIMIT 20",
    "overview": "SELECT label AS type, count(*) AS count FROM {nodes} GROUP BY label ORDER BY count DESC, type",
    "sections": "SELECT c.name AS company, f.fiscal_year AS year, n.accession, n.word_count AS words FROM {companies} c JOIN {filings} f ON f.cik = c.cik JOIN {nodes} n ON n.accession = f.accession AND n.label = 'Section' WHERE c.cik = :cik AND f.fiscal_year = :year AND n.section_type = :section",
    "metrics": "SELECT name AS metric, direction, as_of_year AS year FROM {nodes} WHERE label = 'FinancialMetric' AND cik = :cik AND as_of_year = :year ORDER BY metric LIMIT 30",
}


def template(spark: SparkSession, name: str, tables: dict[str, DataFrame], **params) -> DataFrame:
    query = TEMPLATES[name]
    return ask(spark, query, {t: tables[t] for t in set(re.findall(r"\{(\w+)\}", query))}, **params)


def diagnosed(spark: SparkSession, tables: dict[str, DataFrame], cik: str | None) -> DataFrame:
    """What there is where a query found nothing: the company's years, or an overview of the graph."""
    if cik is not None:
        years = template(spark, "available_years", tables, cik=cik)
        if not years.isEmpty():
            return years
    return template(spark, "overview", tables)


def row_lines(rows: DataFrame, most: int = SHOWN) -> DataFrame:
    """A bullet a row with its fields that aren't null."""
    fields = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in rows.columns]
    return rows.limit(most).select(F.concat(F.lit("• "), F.concat_ws("  |  ", *fields)).alias("line"))


def markdown(messages: DataFrame, conversation: str, order: str) -> DataFrame:
    """One text a conversation: its messages(role, content) in order, each with a rule below."""
    role = F.when(F.col("role") == "user", "**You**").otherwise("**Assistant**")
    part = F.concat(role, F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\n---\n"))
    parts = messages.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(order, part.alias("part")))).alias("parts"))
    return parts.select(conversation, F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("text"))


def answered(questions: DataFrame, evidence: Column, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Questions with the prompt of question and evidence, handed to the caller's model (a transform that adds answer)."""
    prompt = F.concat(F.lit("Answer from this evidence only.\n\n"), evidence, F.lit("\n\nQuestion: "), F.col("question"))
    return model(questions.withColumn("prompt", prompt))


def batches(sentences: DataFrame, document: str, order: str, size: int = 20) -> DataFrame:
    """document, batch and the prompt lines of each size sentences(sentence_id, text) of a document, in order."""
    nth = F.row_number().over(Window.partitionBy(document).orderBy(order)) - 1
    rows = sentences.withColumn("_n", nth).withColumn("batch", F.floor(F.col("_n") / size).cast("int"))
    line = F.concat(F.lit("["), "sentence_id", F.lit("] "), "text")
    lines = rows.groupBy(document, "batch").agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias("l"))
    return lines.select(document, "batch", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"))
