"""Readers for section files, full-text event files, index, ticker and event tables, and section documents."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions import text
from ledgerloom.sources import rtables
from ledgerloom.functions.text import fiscal_year, item_category, item_code

#: Header lines of a section file, in their order.
HEADER = {"cik": "CIK", "company_name": "Company Name", "form_type": "Form Type", "filing_date": "Filing Date", "accession_number": "Accession Number"}
#: Other spellings of index and event columns.
ALIASES = {"form_type": ["form.type", "type"], "cik": ["cik_no", "cik_number"], "company": ["company_name", "company.name"], "date": ["date_filed", "filing_date", "date.filed"], "item_name": ["item", "items", "item.name"], "accession": ["accession_number", "accession.number"]}
SENTENCE = """struct<sentence_id: string, text: string, paragraph_index: int, sentence_index: int, word_count: int, has_company_coref: boolean, is_forward_looking: boolean,
  fl_indicators: array<string>, cik: string, ticker: string, company_name: string, accession_number: string, filing_date: date, fiscal_year: int, section_type: string>"""
SECTION_SCHEMA = f"""section_id string, section_type string, metadata struct<cik: string, ticker: string, company_name: string, form_type: string, accession_number: string,
  filing_date: date, fiscal_year: int>, sentences array<{SENTENCE}>, word_count int, sentence_count int, source_file string"""


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """value, source_file and folder_year (of a folder named by digits) of all .txt files in a folder and its subfolders."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    source = F.col("_metadata.file_path")
    return raw.select("value", source.alias("source_file"), F.nullif(F.regexp_extract(source, r"/(\d+)/[^/]+$", 1), F.lit("")).cast("int").alias("folder_year"))


def section_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a section file that names a company: header fields, fiscal_year, body, source_file and folder_year; others are skipped.

    The header is what stands before the first blank line after a header line; names are read in
    any case and of a repeated field the last counts. cik has no leading zeros; a filing date that
    can't be read is null. A file without such a blank line is header and body at once.
    """
    raw = _texts(spark, path).withColumn("lines", F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)))
    any_field = rf"(?i)^({'|'.join(HEADER.values())}):\s*\S"

    def cut(v: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(v))
        first = F.array_min(F.filter(at, lambda i: F.element_at(v, i).rlike(any_field)))
        return F.array_min(F.filter(at, lambda i: (i > first) & (F.element_at(v, i) == "")))

    raw = raw.withColumn("end", text.let(F.col("lines"), cut))
    head = F.when(F.col("end").isNull(), F.col("lines")).otherwise(F.slice("lines", 1, F.coalesce("end", F.lit(1)) - 1))
    raw = raw.withColumn("head", head)

    def field(name: str) -> Column:
        own = F.filter("head", lambda x: x.rlike(rf"(?i)^{name}:\s*\S"))
        return F.when(F.size(own) > 0, F.trim(F.regexp_extract(F.get(F.slice(own, -1, 1), F.lit(0)), rf"(?i)^{name}:\s*(.+)$", 1)))

    body = F.when(F.col("end").isNull(), F.col("value")).otherwise(F.array_join(F.slice(F.split("value", "\r?\n"), F.coalesce("end", F.lit(0)) + 1, F.greatest(F.size("lines"), F.lit(1))), "\n"))
    rows = raw.select(*[field(v).alias(k) for k, v in HEADER.items()], body.alias("body"), "source_file", "folder_year").where("cik IS NOT NULL")
    number = F.coalesce(F.nullif(F.regexp_replace("cik", "^0+", ""), F.lit("")), F.col("cik"))
    rows = rows.withColumns({"cik": number, "filing_date": F.try_to_date("filing_date", "yyyy-MM-dd"), "form_type": F.coalesce("form_type", F.lit("10-K"))})
    return rows.withColumn("fiscal_year", fiscal_year(F.col("filing_date")))


def event_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a full-text event file with a company's number: accession, filing_date, fiscal_year, company_name, cik, items, body_html and source_file.

    Fields are read within the header block alone, but the accession may also stand before it, and
    is the file's name where it stands nowhere. The body is the first text of an event form's
    document up to the first end of a document.
    """
    raw = _texts(spark, path)
    head = F.regexp_extract("value", r"(?s)\A(.*?<SEC-HEADER>.*?)(?:</SEC-HEADER>|\z)", 1)
    inside = F.regexp_extract("value", r"(?s)<SEC-HEADER>(.*?)(?:</SEC-HEADER>|\z)", 1)
    field = lambda source, pattern: F.nullif(F.trim(F.regexp_extract(source, r"(?im)^[ \t]*" + pattern, 1)), F.lit(""))
    stem = F.regexp_extract("source_file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    upto = F.regexp_extract("value", r"(?is)\A(.*?)(?:^\s*</DOCUMENT>|\z)", 1)
    body = F.regexp_extract(upto, r"(?ism)^\s*<TYPE>8-K.*?^\s*<TEXT>[^\n]*\n?(.*?)(?:^\s*</TEXT>|\z)", 1)
    inline = F.regexp_extract(upto, r"(?is)<TYPE>8-K[^<]*<TEXT>(.*?)(?:</TEXT>|\z)", 1)
    rows = raw.select(
        F.coalesce(field(head, r"ACCESSION NUMBER:\s*(.+)$"), stem).alias("accession"),
        F.try_to_date(field(inside, r"FILED AS OF DATE:\s*(\d{8})\s*$"), "yyyyMMdd").alias("filing_date"),
        field(inside, r"COMPANY CONFORMED NAME:[ \t]*(.+)$").alias("company_name"),
        field(inside, r"CENTRAL INDEX KEY:\s*0*(\d+)\s*$").alias("cik"),
        F.transform(F.regexp_extract_all(inside, F.lit(r"(?im)^[ \t]*ITEM INFORMATION:[ \t]*(.+)$"), F.lit(1)), lambda x: F.trim(x)).alias("items"),
        F.coalesce(F.nullif(body, F.lit("")), inline).alias("body_html"),
        "source_file",
    )
    return rows.where("cik IS NOT NULL").withColumn("fiscal_year", fiscal_year(F.col("filing_date")))


def with_preamble(items: Column, body: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit("Items reported: "), F.array_join(items, "; "), F.lit(".\n\n"), body)).otherwise(body)


def raw_sections(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """source_file, folder_year and the risk section of raw annual filings; filings without one of over least words are left out."""
    found = _texts(spark, path).select("source_file", "folder_year", text.item_1a(F.col("value"), least).alias("section"))
    return found.where("section IS NOT NULL")


def repaired(df: DataFrame) -> DataFrame:
    """Columns in lower snake case, other spellings under the usual name."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    known = {alias: name for name, aliases in ALIASES.items() if name not in names for alias in aliases}
    return df.toDF(*[known.get(n, n.replace(".", "_")) for n in names])


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """An index, ticker or event table: all columns text, names repaired."""
    return repaired(spark.read.csv(path, header=True, sep=sep))


def index_tables(spark: SparkSession, paths: list[str], sep: str = ",") -> DataFrame | None:
    """Index tables of several files bound by column name, missing columns null; files that can't be read are left out.

    Files ending in .parquet are read as such, those ending in .rda, .RData or .rds as R's own. None if no file can be read.
    """
    tables = []
    for p in paths:
        try:
            if p.lower().endswith(rtables.ENDINGS):
                found = rtables.r_table(spark, p)
                if found is None:
                    continue
                table = repaired(found.drop("source_file"))
            else:
                table = repaired(spark.read.parquet(p)) if p.endswith(".parquet") else delimited(spark, p, sep)
            tables.append(table.select([F.col(c).cast("string") for c in table.columns]))
        except AnalysisException:
            continue
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else None


def filers(index: DataFrame, tickers: DataFrame, forms: list[str] = fixed.FORM_TYPES) -> DataFrame:
    """cik and ticker of companies with a filing of the forms: of several tickers the first, ordered by cik as text."""
    own = index.where(F.col("form_type").isin(forms)).select(text.cik(F.col("cik")).alias("cik")).distinct()
    first = tickers.select(text.cik(F.col("cik")).alias("cik"), "ticker").groupBy("cik").agg(F.min("ticker").alias("ticker"))
    return own.join(first, "cik").orderBy("cik")


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """ticker and cik (without leading zeros) of a ticker table; several tickers of a company stay."""
    rows = delimited(spark, path)
    return rows.select("ticker", F.regexp_replace("cik", "^0+", "").alias("cik")).where("ticker IS NOT NULL AND cik IS NOT NULL")


def ticker_by_cik(table: DataFrame) -> DataFrame:
    """One ticker a company, the last in order."""
    return table.groupBy("cik").agg(F.max("ticker").alias("ticker"))


def cik_by_ticker(table: DataFrame) -> DataFrame:
    """One company a ticker in upper case."""
    return table.groupBy(F.upper("ticker").alias("ticker")).agg(F.max("cik").alias("cik"))


def enriched(filings: DataFrame, table: DataFrame) -> DataFrame:
    """Filings with their company's ticker, null where there is none."""
    return filings.join(ticker_by_cik(table), "cik", "left")


def section_documents(spark: SparkSession, path: str) -> DataFrame:
    """Section documents from JSON files, one a file; files that aren't such a document are skipped."""
    rows = spark.read.schema(SECTION_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    return rows.where("section_id IS NOT NULL")


def section_keys(documents: DataFrame) -> DataFrame:
    """section_id of all documents: of columnar files only that column is read."""
    return documents.select("section_id")


def sentences(documents: DataFrame) -> DataFrame:
    """The sentences of section documents with seq, their place."""
    return documents.select("section_id", F.posexplode("sentences").alias("seq", "s")).select("section_id", "seq", "s.*")


def filing_index(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """companies(cik, ticker, name) and filings as documents describe them; of several for one key that of the last file counts.

    Documents without cik, accession or date are left out.
    """
    m = lambda c: F.trim(F.coalesce(F.col(f"metadata.{c}").cast("string"), F.lit("")))
    rows = documents.select(
        m("accession_number").alias("accession"), m("cik").alias("cik"), m("ticker").alias("ticker"), m("company_name").alias("company_name"),
        F.coalesce(F.nullif(m("form_type"), F.lit("")), F.lit("10-K")).alias("form_type"), F.col("metadata.filing_date").alias("filing_date"),
        F.col("metadata.fiscal_year").alias("fiscal_year"), F.col("source_file").alias("file_path"),
    ).where("cik <> '' AND accession <> '' AND filing_date IS NOT NULL")
    last = lambda key, *cols: rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("file_path", "accession")).alias("r")).select(key, "r.*")
    companies = last("cik", "ticker", F.col("company_name").alias("name"))
    return companies, last("accession", "cik", "ticker", "company_name", "form_type", "filing_date", "fiscal_year", "file_path")


def preprocessed(files: DataFrame, section: str, table: DataFrame | None = None) -> DataFrame:
    """Section documents from section files (or event files with their preamble): cleaned, split and tagged.

    Sentences under three words are left out and those kept are numbered in order.
    """
    if "items" in files.columns:
        files = files.select("*", with_preamble(F.col("items"), text.clean(F.col("body_html"))).alias("plain"), F.col("accession").alias("accession_number"), F.lit("8-K").alias("form_type"))
    else:
        files = files.withColumn("plain", text.clean(F.col("body")))
    files = enriched(files, table) if table is not None else files.withColumn("ticker", F.lit(None).cast("string"))
    meta = ["cik", "ticker", "company_name", "accession_number", "filing_date", "fiscal_year"]
    trimmed = lambda p: F.filter(F.transform(F.split(p, text.SENTENCE_END), lambda x: F.trim(x)), lambda s: s != "")
    split = lambda p, i: F.transform(trimmed(p), lambda s, j: F.struct(s.alias("text"), i.alias("paragraph_index"), j.alias("sentence_index"), text.word_count(s).cast("int").alias("word_count")))
    kept = F.filter(F.flatten(F.transform(text.paragraphs(F.col("plain")), split)), lambda s: s["word_count"] >= 3)

    def tagged(s: Column, i: Column) -> Column:
        t = text.tags(s["text"])
        return F.struct(
            text.sentence_id(F.col("accession_number"), F.lit(section), i).alias("sentence_id"), s["text"], s["paragraph_index"], s["sentence_index"], s["word_count"],
            t["has_company_coref"].alias("has_company_coref"), t["is_forward_looking"].alias("is_forward_looking"), t["fl_indicators"].alias("fl_indicators"),
            *[F.col(c).cast("int" if c == "fiscal_year" else files.schema[c].dataType).alias(c) for c in meta], F.lit(section).alias("section_type"),
        )

    files = files.withColumn("sentences", F.transform(kept, tagged))
    return files.select(
        text.section_id(F.col("cik"), F.col("accession_number"), F.lit(section)).alias("section_id"), F.lit(section).alias("section_type"),
        F.struct("cik", "ticker", "company_name", "form_type", "accession_number", "filing_date", F.col("fiscal_year").cast("int").alias("fiscal_year")).alias("metadata"), "sentences",
        F.aggregate("sentences", F.lit(0), lambda a, s: a + s["word_count"]).alias("word_count"), F.size("sentences").alias("sentence_count"), "source_file",
    )


def item_events(rows: DataFrame) -> DataFrame:
    """Events of a table with cik, accession, item_name and date: event_id, cik, accession, date, fiscal_year, code and category (other if unknown).

    Rows without one of the four, or with a date that can't be read, are left out.
    """
    code = item_code(F.trim("item_name"))
    out = rows.withColumns({"date": F.try_to_date("date", "yyyy-MM-dd"), "cik": F.regexp_replace("cik", "^0+", ""), "code": code})
    out = out.where("date IS NOT NULL AND cik <> '' AND trim(accession) <> '' AND trim(item_name) <> ''")
    key = F.concat_ws("_", F.lit("8k"), "cik", text.accession_clean(F.col("accession")), text.slugify(F.coalesce("code", "item_name"), 40))
    return out.select(key.alias("event_id"), "cik", "accession", "date", fiscal_year(F.col("date")).alias("fiscal_year"), "code", item_category(F.col("code")).alias("category"))


def event_graph(events: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event nodes, and the edges of events to companies that exist and to years of the chain."""
    nodes = events.select(F.col("event_id").alias("node_id"), F.lit("Event8K").alias("label"), "cik", "accession", "date", "fiscal_year", "code", "category")
    own = events.join(companies.select("cik").distinct(), "cik", "left_semi")
    of = own.select(F.col("cik").alias("subject_id"), F.lit("HAS_8K_EVENT").alias("relation_type"), F.col("event_id").alias("object_id"))
    year = events.where(F.col("fiscal_year").between(fixed.FIRST_YEAR, fixed.LAST_YEAR))
    return nodes, of.unionByName(year.select(F.col("event_id").alias("subject_id"), F.lit("FILED_IN").alias("relation_type"), F.format_string("fy_%d", "fiscal_year").alias("object_id")))


def file_counts(spark: SparkSession, path: str) -> DataFrame:
    """folder_year and the number of text files in folders named by a year; only names are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path).select("path")
    return rows.groupBy(F.nullif(F.regexp_extract("path", r"/(\d+)/[^/]+$", 1), F.lit("")).cast("int").alias("folder_year")).agg(F.count("*").alias("files"))
