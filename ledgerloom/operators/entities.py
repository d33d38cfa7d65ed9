"""Raw extraction records from tagged sentences, by rules and a gazetteer of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import names, normalise
from ledgerloom.shared import stage

LONGEST = 5
#: Entity labels of a gazetteer, with the node type and relation that each gives.
KINDS = {"ORG": ("Competitor", "COMPETES_WITH"), "GPE": ("GeographicMarket", "OPERATES_IN"), "LOC": ("GeographicMarket", "OPERATES_IN")}
DOC = ["cik", "accession", "section_type"]


def spans(sentence: Column, longest: int = LONGEST) -> Column:
    """Runs of one to longest words as structs (at, name), signs at their ends left out; words that are signs alone begin and end none."""

    def runs(w: Column) -> Column:
        def of(n: int) -> Column:
            at = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
            name = lambda i: F.regexp_replace(F.array_join(F.slice(w, i, n), " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "")
            inner = F.filter(at, lambda i: F.get(w, i - 1).rlike(r"[\p{L}\p{N}]") & F.get(w, i + (n - 2)).rlike(r"[\p{L}\p{N}.]"))
            return F.when(F.size(w) >= n, F.transform(inner, lambda i: F.struct(i.alias("at"), name(i).alias("name")))).otherwise(F.array().cast("array<struct<at: int, name: string>>"))

        return F.filter(F.concat(*[of(n) for n in range(longest, 0, -1)]), lambda s: s["name"].rlike(r"^\p{Lu}"))

    return text.let(F.filter(F.split(sentence, r"\s+"), lambda x: x != ""), runs)


def named(sentences: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Sentence columns but text, at, name and label of the names of gazetteer(name, label) in sentences, whatever their case.

    A gazetteer of up to names.AUTOMATON_NAMES names goes to all tasks as one automaton; a larger
    one is joined to all runs of words. Of several labels of a name the least counts.
    """
    if gazetteer.count() <= names.AUTOMATON_NAMES:
        return names.by_gazetteer(sentences, names.gazetteer_of(gazetteer))
    return joined(sentences, gazetteer)


def joined(sentences: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """named() by a join of all runs of one to five words."""
    known = gazetteer.groupBy(F.lower("name").alias("_key")).agg(F.min("label").alias("label"))
    keep = [c for c in sentences.columns if c != "text"]
    found = sentences.select(*keep, F.explode(spans(F.col("text"))).alias("s")).select(*keep, "s.*").withColumn("_key", F.lower("name"))
    return found.join(known, "_key").drop("_key")


def extracted(sentences: DataFrame, gazetteer: DataFrame | None = None, tagger: names.Tagger | None = None) -> DataFrame:
    """cik, accession, section_type, nodes and relations, as the normaliser takes them; names by a gazetteer or by a learnt tagger.

    sentences(cik, accession, section_type, company_name, seq, text, is_forward_looking). Names are
    taken once a document, at their first mention, the company's own left out; money amounts (of
    metric names of over three characters, once each) and forward-looking sentences count in
    management discussions only.
    """
    base = [*DOC, "company_name", "seq"]
    own = sentences.select(*base, "text")
    found = names.by_tagger(own, tagger) if tagger else named(own, gazetteer)
    found = found.where((F.col("label") != "ORG") | ~text.is_self_reference(F.col("name"), F.col("company_name")))
    kind = lambda k: text.lookup({label: v[k] for label, v in KINDS.items()})[F.col("label")]
    blank = {k: F.lit(None).cast("string") for k in ("direction", "sentiment", "horizon", "text")}
    found = found.select(*base, "at", kind(0).alias("type"), "name", kind(1).alias("relation"), F.lit(0).alias("part"), *[v.alias(k) for k, v in blank.items()])
    mda = sentences.where("section_type = 'mda'")
    amounts = mda.select(*base, "text", F.posexplode(text.metric_names(F.col("text"))).alias("at", "name")).where(F.length("name") > 3)
    amounts = amounts.select(*base, "at", F.lit("FinancialMetric").alias("type"), "name", F.lit("REPORTS").alias("relation"), F.lit(1).alias("part"),
                             text.direction(F.col("text")).alias("direction"), *[blank[k].alias(k) for k in ("sentiment", "horizon", "text")])
    # staged, since the two are short and their plans long
    once = stage(found, "names").unionByName(stage(amounts, "amounts"))
    rest = [c for c in once.columns if c not in (*DOC, "type")]
    once = once.withColumn("_key", F.lower("name")).groupBy(*DOC, "type", "_key").agg(F.min_by(F.struct(*rest), F.struct("seq", "part", "at")).alias("m")).select(*DOC, "type", "m.*")
    outlook = mda.where("is_forward_looking").select(
        *base, F.lit(0).alias("at"), F.lit("ManagementOutlook").alias("type"), blank["text"].alias("name"), F.lit("HAS_OUTLOOK").alias("relation"), F.lit(2).alias("part"),
        blank["direction"].alias("direction"), text.sentiment(F.col("text")).alias("sentiment"), F.lit("full_year").alias("horizon"), "text",
    )
    rows = once.unionByName(outlook)
    fields = {k: F.col(k) if k in ("type", "name", "direction", "sentiment", "horizon", "text") else F.lit(None) for k in normalise.NODE}
    node = F.struct(*[c.cast(normalise.NODE[k]).alias(k) for k, c in fields.items()]).alias("node")
    relation = F.struct(
        F.lit("Company").alias("subject_type"), F.col("company_name").alias("subject_title"), F.col("relation"), F.col("type").alias("object_type"),
        F.coalesce("name", F.substring("text", 1, 40)).alias("object_title"),
    ).alias("relation")
    items = F.array_sort(F.collect_list(F.struct("seq", "part", "at", "node", "relation")))
    grouped = rows.select(*DOC, "seq", "part", "at", node, relation).groupBy(*DOC).agg(items.alias("items"))
    return grouped.select(*DOC, F.transform("items", lambda i: i["node"]).alias("nodes"), F.transform("items", lambda i: i["relation"]).alias("relations"))
