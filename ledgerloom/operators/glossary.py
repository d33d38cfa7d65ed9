"""The glossary: terms found in sentences, merged over all documents.

A store is kept as tables, a row a term and a row a fact about it, so that a term with very many
sources is no larger a row than others; nested() puts one together for readers who want it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.shared import stage

MENTION = "term string, alias string, definition string, expansion string, is_acronym boolean, tags array<string>"
LEAST_WORDS = 8


def mentions(sentences: DataFrame, definition: str | None = None, acronym: bool = True) -> DataFrame:
    """Terms of sentences(cik, accession, section_type, sentence_id, text): their columns, place and the mention's fields.

    definition is a pattern of two groups in place of the usual one. Definitions of a sentence come
    before its acronyms.
    """

    def defined(p: Column) -> Column:
        mention = lambda term: F.struct(term.alias("term"), F.lit(None).cast("string").alias("alias"), p["definition"].alias("definition"), F.lit(None).cast("string").alias("expansion"), F.lit(False).alias("is_acronym"), text.domain_tags(term).alias("tags"))
        return text.let(text.normalise_term(p["term"]), mention)

    def short(p: Column) -> Column:
        long = p["expansion"]
        return F.struct(text.normalise_term(p["acronym"]).alias("term"), text.normalise_term(long).alias("alias"), F.lit(None).cast("string").alias("definition"), F.lower(long).alias("expansion"), F.lit(True).alias("is_acronym"), text.domain_tags(long).alias("tags"))

    t = F.col("text")
    found = F.transform(text.definitions(t, definition) if definition else text.definitions(t), defined)
    found = F.concat(found, F.transform(text.acronyms(t), short)) if acronym else found
    columns = [c for c in sentences.columns if c != "text"]
    rows = sentences.select(*columns, F.posexplode(found).alias("place", "m"))
    return rows.select(*columns, "place", "m.*")


def candidates(sentences: DataFrame) -> DataFrame:
    """Sentences long enough for a language model to look at."""
    return sentences.where(F.col("word_count") >= LEAST_WORDS)


#: What a store keeps, and by which key: facts with the place where each was first met.
FACTS = {
    "terms": ["key"], "aliases": ["key", "alias"], "scopes": ["key", "scope"], "tags": ["key", "tag"], "sources": ["key", "sentence_id"], "companies": ["key", "cik"],
}
FIRST = ["term", "definition", "expansion", "is_acronym"]


def told(found: DataFrame, *order: str) -> dict[str, DataFrame]:
    """The facts that each mention gives, a table a kind, as often as they are given; combined() keeps the earliest.

    Mentions with one lower-case term are one entry; those with a null term give nothing.
    """
    seq = F.struct(*order, "place")
    m = stage(found.withColumns({"key": F.lower(F.trim("term")), "seq": seq}).where("key IS NOT NULL"), "mentions")
    set_at = lambda c: F.when(F.col(c).isNotNull(), F.col("seq"))
    tags = m.select("key", F.posexplode("tags").alias("nth", "tag"), "seq")
    rows = {
        "terms": m.select("key", *FIRST, *(set_at(c).alias(f"{c}_seq") for c in FIRST)),
        "aliases": m.select("key", "alias", "seq"),
        "scopes": m.select("key", F.col("section_type").cast("string").alias("scope"), "seq"),
        "tags": tags.select("key", "tag", F.struct("seq", "nth").alias("seq")),
        "sources": m.select("key", "cik", "accession", "section_type", "sentence_id", "seq"),
        "companies": m.select("key", "cik").distinct(),
    }
    return {name: rows[name].where(F.col(keys[-1]).isNotNull() | F.lit(name == "sources")) for name, keys in FACTS.items()}


def facts(found: DataFrame, *order: str) -> dict[str, DataFrame]:
    """The facts that mentions give, a table a kind, each with the place where it was first met."""
    return {name: combined(name, rows) for name, rows in told(found, *order).items()}


def combined(name: str, rows: DataFrame) -> DataFrame:
    """Facts of one kind with the earliest of each key: the same for any order and number of runs."""
    keys = FACTS[name]
    if name == "companies":
        return rows.select(keys).distinct()
    if name == "terms":
        first = lambda c: F.min(F.when(F.col(f"{c}_seq").isNotNull(), F.struct(f"{c}_seq", c))).alias(c)
        least = rows.groupBy("key").agg(*(first(c) for c in FIRST))
        return least.select("key", *(F.col(c)[c].alias(c) for c in FIRST), *(F.col(c)[f"{c}_seq"].alias(f"{c}_seq") for c in FIRST))
    rest = [c for c in rows.columns if c not in (*keys, "seq")]
    least = rows.groupBy(*keys).agg(F.min(F.struct("seq", *rest)).alias("_first"))
    return least.select(*keys, "_first.*").select(rows.columns)


def store_of(held: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables terms, aliases, scopes, tags and sources that facts make: terms with the numbers of companies and sources, aliases that differ from the term."""
    count = lambda name, c, n: held[name].groupBy("key").agg(F.count(c).alias(n))
    terms = held["terms"].select("key", *FIRST).join(count("companies", "cik", "frequency"), "key", "left").join(count("sources", "sentence_id", "n_sources"), "key", "left")
    terms = terms.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in ("frequency", "n_sources")})
    own = terms.select("key", F.col("term").alias("_term"))
    aliases = held["aliases"].join(own, "key").where("alias <> _term").drop("_term")
    return {"terms": terms, "aliases": aliases, **{name: held[name] for name in ("scopes", "tags", "sources")}}


def merged(found: DataFrame, *order: str) -> dict[str, DataFrame]:
    """The store of mentions: tables terms, aliases, scopes, tags and sources, each by key.

    The first in order gives the term; of definition, expansion and is_acronym the first that isn't
    null counts; frequency is the number of distinct companies. Aliases, scopes and tags come in the
    order in which they are first met, sources once a sentence.
    """
    return store_of(facts(found, *order))


def nested(store: dict[str, DataFrame], sources: bool = False) -> DataFrame:
    """One row a term with arrays of its aliases, scopes and tags in order, and of its sources if asked for."""
    out = store["terms"]
    lists = {"aliases": "alias", "scopes": "scope", "tags": "tag"} | ({"sources": "sentence_id"} if sources else {})
    for name, column in lists.items():
        rows = store[name].groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", column)))[column].alias(name))
        out = out.join(rows, "key", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def entry_text(df: DataFrame) -> Column:
    """What a term is embedded by: term: definition, else term (expansion), else the term."""
    return F.when(F.col("definition").isNotNull(), F.concat("term", F.lit(": "), "definition")).when(F.col("expansion").isNotNull(), F.concat("term", F.lit(" ("), "expansion", F.lit(")"))).otherwise(F.col("term"))
