"""Text, glossary, severity, diff and vector queries over the operators, with their SQL where there is one.

The documents are invented prose without the domain's words, so rules that take word lists are run
with common words too; SQL then has the same lists.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions import tables, text
from ledgerloom.operators import ann, chat, diff, entities, glossary, graph, latent, names, segment, similar, vectors
from ledgerloom.plans.graph_queries import _sql_any, _sql_in
from ledgerloom.shared import shared_dir, stage
from ledgerloom.sources import sinks
from ledgerloom.streaming import metrics, windows

WORDS = ["the", "that", "with", "from", "this"]
#: Common words between explicit classes, which both engines read alike in any language.
HIGH, MED = ([text.whole_word(w) for w in words] for words in (("idiot", "with"), ("from", "this")))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def forward_looking_pct(spark: SparkSession, sf: str) -> DataFrame:
    """Share of documents with any of some words, by source; one pattern for all words."""
    flag = F.lower("text").rlike(text.whole_word(f"({'|'.join(WORDS)})"))
    n, k = F.count("*"), F.count_if(flag)
    return _docs(spark, sf).groupBy("source").agg(n.alias("docs"), k.alias("flagged"), F.round(100 * k / n, 1).alias("pct"))


_FLAG = f"regexp_matches(lower(text), '{text.whole_word('(' + '|'.join(WORDS) + ')')}')"
FORWARD_SQL = f"""SELECT source, count(*) AS docs, CAST(count(*) FILTER (WHERE {_FLAG}) AS BIGINT) AS flagged,
  round(100.0 * count(*) FILTER (WHERE {_FLAG}) / count(*), 1) AS pct FROM documents GROUP BY 1"""


def severity_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", text.severity(F.col("text"), HIGH, MED).alias("severity"), text.severity(F.col("text")).alias("fixed_severity"))


_CASE = lambda high, med: f"CASE WHEN {_sql_any('lower(text)', high)} THEN 'HIGH' WHEN {_sql_any('lower(text)', med)} THEN 'MED' ELSE 'LOW' END"
SEVERITY_SQL = f"SELECT doc_id, {_CASE(HIGH, MED)} AS severity, {_CASE(fixed.HIGH_SEVERITY, fixed.MEDIUM_SEVERITY)} AS fixed_severity FROM documents"


def overall_severity(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select("source", text.severity(F.col("text"), HIGH, MED).alias("severity"))
    return rows.groupBy("source").agg(text.overall(F.col("severity")).alias("severity"))


OVERALL_SQL = f"""SELECT source, CASE min(CASE {_CASE(HIGH, MED)} WHEN 'HIGH' THEN 0 WHEN 'MED' THEN 1 ELSE 2 END) WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MED' ELSE 'LOW' END AS severity FROM documents GROUP BY 1"""


def reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why a document would matter, those with a language code as added, others as removed."""
    change = F.when(F.col("lang").isNotNull(), "added").otherwise("removed")
    return _docs(spark, sf).select("doc_id", text.reason(F.col("text"), change).alias("why"), text.direction(F.col("text")).alias("direction"), text.sentiment(F.col("text")).alias("sentiment"))


REASONS_SQL = f"""SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{w}'" for p, w in fixed.REASONS)}
    WHEN lang IS NOT NULL THEN '{fixed.REASON_ADDED}' ELSE '{fixed.REASON_OTHER}' END AS why,
  CASE WHEN {_sql_in("lower(text)", fixed.INCREASE_WORDS)} THEN 'increase' WHEN {_sql_in("lower(text)", fixed.DECREASE_WORDS)} THEN 'decrease' ELSE 'not_stated' END AS direction,
  CASE WHEN {_sql_in("lower(text)", fixed.POSITIVE_WORDS)} THEN 'positive' WHEN {_sql_in("lower(text)", fixed.CAUTIOUS_WORDS)} THEN 'cautious' ELSE 'neutral' END AS sentiment FROM documents"""


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    tidy = text.normalise_whitespace(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.md5(tidy).alias("digest"), F.md5(text.clean(F.col("text"))).alias("cleaned"))


_TIDY = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"""
_TIDY_TEXT = _TIDY.replace("{0}", "text")


def _boilerplate(value: str) -> str:
    for p in fixed.BOILERPLATE:
        value = f"regexp_replace({value}, '{p}', '', 'g')"
    return value


CLEAN_SQL = f"SELECT doc_id, md5({_TIDY_TEXT}) AS digest, md5({_boilerplate(_TIDY_TEXT)}) AS cleaned FROM documents"


def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", text.normalise_whitespace(text.strip_html(F.col("html"))).alias("text"))


def sentence_segmentation(spark: SparkSession, sf: str) -> DataFrame:
    return text.sentences(_docs(spark, sf), "doc_id", "text")


def sentence_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    rows = text.sentences(docs, "doc_id", "text").select("doc_id", "seq", "word_count").join(docs.select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", text.sentence_id(F.col("doc_id"), F.coalesce("lang", F.lit("none")), F.col("seq")).alias("sentence_id"), "word_count")


def slugify_names(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", text.slugify(F.col("p_name")).alias("slug"), text.slugify(F.col("p_brand"), 40).alias("brand"), text.company_name(F.col("p_name")).alias("upper"), text.accession_clean(F.col("p_brand")).alias("plain"))


SLUG_SQL = """SELECT p_partkey, substring(trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_'), 1, 60) AS slug,
  substring(trim(regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40) AS brand, regexp_replace(upper(p_name), ' {2,}', ' ', 'g') AS upper,
  regexp_replace(p_brand, '[^0-9a-zA-Z]', '', 'g') AS plain FROM part"""

#: A word before `of` or `de` stands for a term, the word after it for its definition.
TERM = r"([A-Za-z]{3,30}) (?:of|de|der|the) ([A-Za-z]{2,30})"


def glossary_extract(spark: SparkSession, sf: str) -> DataFrame:
    return text.glossary(_docs(spark, sf), "doc_id", "text", TERM)


_NORM = "regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '^the ', ''), '^a ', ''), '^an ', '')"
GLOSSARY_SQL = f"""SELECT term, count(*) AS frequency, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, {_NORM} AS term
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{TERM}', 1)) AS raw FROM documents)) WHERE length(term) >= 3 GROUP BY 1"""


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sentences of their source."""
    s = _docs(spark, sf).select(F.col("source").alias("cik"), F.col("doc_id").alias("accession"), F.coalesce("lang", F.lit("none")).alias("section_type"), F.col("doc_id").cast("string").alias("sentence_id"), "text")
    return glossary.mentions(s, TERM, acronym=False)


def glossary_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(glossary.merged(_mentions(spark, sf), "accession"))


def glossary_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The store after three runs, over documents of odd ids, of even ones, and of odd ones again."""
    found, path = _mentions(spark, sf), f"{shared_dir(spark)}/glossary_upsert-{uuid.uuid4().hex}"
    odd = F.expr("accession % 2 = 1")
    for half in (odd, ~odd, odd):
        store = sinks.write_glossary(found.where(half), path, "accession", buckets=4)
    return _terms(store)


def _terms(store: dict[str, DataFrame]) -> DataFrame:
    out = glossary.nested(store)
    return out.select("term", "definition", "frequency", "n_sources", F.array_join("scopes", ",").alias("scopes"), F.array_join("tags", ",").alias("tags"))


_TAGS = "CASE WHEN len(t) = 0 THEN 'other' ELSE array_to_string(t, ',') END"
_TAG_LIST = "list_filter([" + ", ".join(f"CASE WHEN {_sql_in('term', keys)} THEN '{d}' END" for d, keys in fixed.DOMAINS.items()) + "], lambda x: x IS NOT NULL)"
MERGE_SQL = f"""WITH raw AS (SELECT doc_id, source, coalesce(lang, 'none') AS lang, unnest(regexp_extract_all(text, '{TERM}', 1)) AS raw, unnest(regexp_extract_all(text, '{TERM}', 2)) AS def,
    unnest(range(1, len(regexp_extract_all(text, '{TERM}', 1)) + 1)) AS pos FROM documents),
  m AS (SELECT *, {_NORM} AS term, doc_id * 100000 + pos AS seq FROM raw WHERE length({_NORM}) >= 3),
  s AS (SELECT term, lang, min(seq) AS first FROM m GROUP BY 1, 2), l AS (SELECT term, string_agg(lang, ',' ORDER BY first) AS scopes FROM s GROUP BY 1),
  g AS (SELECT term, arg_min(trim(def), seq) AS definition, count(DISTINCT source) AS frequency, count(DISTINCT doc_id) AS n_sources FROM m GROUP BY 1)
  SELECT g.term, definition, frequency, n_sources, scopes, {_TAGS} AS tags FROM (SELECT *, {_TAG_LIST} AS t FROM g) g JOIN l ON g.term = l.term"""


def domain_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.array_join(text.domain_tags(F.col("text")), ",").alias("tags"))


TAGS_SQL = f"SELECT doc_id, {_TAGS} AS tags FROM (SELECT doc_id, {_TAG_LIST.replace('term', 'lower(text)')} AS t FROM documents)"


def corpus_trend(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 1).alias("avg_chars"))


TREND_SQL = "SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 1) AS avg_chars FROM documents GROUP BY 1"


def pct_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by length in 30 bins of one width."""
    docs = _docs(spark, sf).select("n_chars")
    span = docs.agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo")) / 30, F.lit(1e-9))
    at = F.least(F.floor((F.col("n_chars") - F.col("lo")) / width), F.lit(29)).cast("long")
    return docs.join(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("docs"))


HISTOGRAM_SQL = """SELECT CAST(least(floor((n_chars - lo) / greatest((hi - lo) / 30, 1e-9)), 29) AS BIGINT) AS bin, count(*) AS docs
  FROM documents, (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) GROUP BY 1"""


def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", text.word_count(F.col("text")).alias("words"))


WORDS_SQL = r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '')) AS words FROM documents"


def metric_stubs(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts of whole texts and the names before them, where common words stand for amounts that differ by the document."""
    t, n = F.col("text"), F.pmod("doc_id", F.lit(997)).cast("string")
    for word, unit in AMOUNTS.items():
        t = F.replace(t, F.lit(f" {word} "), F.concat(F.lit(" $"), n, F.lit(f"{unit} ")))
    rows = _docs(spark, sf).select("doc_id", t.alias("text"))
    return rows.select("doc_id", F.array_join(text.metric_names(F.col("text")), ";").alias("names"), F.array_join(text.amounts(F.col("text")), ";").alias("amounts"))


AMOUNTS = {"the": ".5 million", "der": ",000", "les": " billion", "los": ".25"}


def sql_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of three words or more of all texts, by SQL alone."""
    return tables.register(spark).sql("SELECT doc_id, s.* FROM {docs} AS d, LATERAL text_sentences(d.text) AS s", docs=_docs(spark, sf))


SENTENCES_SQL = r"""WITH p AS (SELECT doc_id, unnest(l) AS p, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, list_filter(list_transform(
    regexp_split_to_array(text, '\n{2,}'), lambda x: trim(x)), lambda x: length(x) >= 10) AS l FROM documents)),
  s AS (SELECT doc_id, i, unnest(l) AS s, unnest(range(0, len(l))) AS j FROM (SELECT doc_id, i, list_filter(list_transform(
    string_split(regexp_replace(p, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM p)),
  n AS (SELECT *, len(list_filter(regexp_split_to_array(s, '[ \t\n\r\f]+'), lambda w: w <> '')) AS n FROM s)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS seq, CAST(i AS INTEGER) AS paragraph_index,
    CAST(j AS INTEGER) AS sentence_index, s AS sentence, n AS words FROM n WHERE n >= 3"""


def sql_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts of whole texts, a row each, where common words stand for amounts that differ by the document; by SQL alone."""
    return tables.register(spark).sql(f"SELECT doc_id, a.* FROM (SELECT doc_id, {_amounts_sql('STRING')} AS text FROM {{docs}}) AS d, LATERAL text_amounts(d.text) AS a", docs=_docs(spark, sf))


def _amounts_sql(kind: str) -> str:
    c = "text"
    for word, unit in AMOUNTS.items():
        c = f"replace({c}, ' {word} ', concat(' $', CAST(doc_id % 997 AS {kind}), '{unit} '))"
    return c


AMOUNTS_SQL = f"""SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS seq, trim(unnest(l)) AS amount
  FROM (SELECT doc_id, regexp_extract_all({_amounts_sql('VARCHAR')}, '(?i){fixed.MONEY}') AS l FROM documents)"""


def _gazetteer(docs: DataFrame) -> DataFrame:
    """Frequent capitalised words as names."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]{4,9})\b"), F.lit(1))).alias("name"))
    return words.groupBy("name").agg(F.count("*").alias("n")).where("n >= 50").select("name", F.when(F.length("name") % 2 == 0, "ORG").otherwise("GPE").alias("label"))


def learnt_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of all lines of texts by a tagger that learns from documents whose crc32 of the id isn't divisible by five, and how many the gazetteer has there too."""
    docs = _docs(spark, sf)
    held = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")
    lines = docs.select("doc_id", held, F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.select("doc_id", "held_out", "line", "text")
    known = _gazetteer(docs)
    found = names.by_tagger(lines, names.learn(lines.where("NOT held_out"), known)).select("doc_id", "held_out", "line", "at", "name", "label", F.lit(1).alias("learnt"))
    marked = entities.named(lines, known).select("doc_id", "held_out", "line", "at", "name", "label", F.lit(1).alias("marked"))
    both = found.join(marked, ["doc_id", "held_out", "line", "at", "name", "label"], "full")
    n = lambda c: F.count(c).alias(c)
    return both.groupBy("doc_id", "held_out", "label").agg(n("learnt"), n("marked"), F.count_if(F.col("learnt") == F.col("marked")).alias("both"))


def entity_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records of documents whose gazetteer is the frequent capitalised words of all documents; a record's items as counts."""
    docs = _docs(spark, sf)
    known = _gazetteer(docs)
    s = docs.select(F.col("source").alias("cik"), F.col("doc_id").alias("accession"), F.lit("mda").alias("section_type"), F.col("source").alias("company_name"), F.lit(0).alias("seq"), "text", F.lower("text").contains("the").alias("is_forward_looking"))
    out = entities.extracted(s.where("text IS NOT NULL"), known)
    kind = lambda t: F.size(F.filter("nodes", lambda n: n["type"] == t)).cast("long")
    return out.select(F.col("accession").alias("doc_id"), kind("Competitor").alias("competitors"), kind("GeographicMarket").alias("markets"), kind("ManagementOutlook").alias("outlooks"), F.size("relations").cast("long").alias("relations"))


def _queries(e: DataFrame) -> DataFrame:
    """Every row whose number is divisible by 20 is a query."""
    return e.where("vec_id % 20 = 0")


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return vectors.search(e, _queries(e), "vec_id", "embedding", 10).select("query", "vec_id", "score")


def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    where = vectors.predicate({"$and": [{"label": {"$in": [1, 2, 3]}}, {"label": {"$lte": 2}}]})
    return vectors.search(e, _queries(e), "vec_id", "embedding", 10, where).select("query", "vec_id", "score")


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of a run that writes the lines of all documents, taken while it writes."""
    lines = _docs(spark, sf).select("doc_id", "lang", F.explode(_lines(F.col("text"))).alias("line"))
    n = F.count("*")
    lines, seen = metrics.observed(lines, lines=n, characters=F.sum(F.length("line")), without_lang=n - F.count("lang"), last=F.max("doc_id"))
    stage(lines, "lines")
    return spark.createDataFrame(sorted(seen.get.items()), "metric string, value long")


RUN_METRICS_SQL = """WITH l AS (SELECT doc_id, lang, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents),
  f AS (SELECT count(*) AS lines, sum(length(line)) AS characters, count(*) - count(lang) AS without_lang, max(doc_id) AS last FROM l WHERE line <> '')
  SELECT metric, CAST(value AS BIGINT) AS value FROM (SELECT unnest(['characters', 'last', 'lines', 'without_lang']) AS metric, unnest([characters, last, lines, without_lang]) AS value FROM f)"""


def latent_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten documents nearest to each of those whose id is divisible by 20, in a space of 24 directions that all texts teach."""
    docs = _docs(spark, sf)
    vector = stage(latent.space(docs, "doc_id", "text", 24).embed(docs, "doc_id", "text"), "latent")
    return vectors.search(vector, vector.where("doc_id % 20 = 0"), "doc_id", "vector", 10)


def glossary_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The five glossary entries nearest to each document whose id is divisible by 20, in a space that the entries teach."""
    terms = glossary.merged(_mentions(spark, sf), "accession")["terms"]
    entries = stage(terms.select("key", glossary.entry_text(terms).alias("entry")), "entries")
    asked = _docs(spark, sf).where("doc_id % 20 = 0").select("doc_id", "text")
    found = latent.lookup(latent.space(entries, "key", "entry", 24), entries, "key", "entry", asked, "doc_id", "text")
    return found.select("doc_id", F.col("key").alias("term"), "score", "rank")


def _abbreviated(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts with common words of each language put as abbreviations."""
    t = F.col("text")
    for word, short in SHORT.items():
        t = F.replace(t, F.lit(f" {word} "), F.lit(f" {short} "))
    return _docs(spark, sf).select("doc_id", t.alias("text"))


SHORT = {"the": "Corp.", "der": "z.B.", "les": "env.", "los": "Sr."}


def sentence_end_model(spark: SparkSession, sf: str) -> DataFrame:
    """Abbreviations and sentence starters that the texts themselves teach, with their counts and scores."""
    model = segment.learn(_abbreviated(spark, sf), "text")
    score = F.round("score", 4).alias("score")
    return model["abbreviations"].select(F.lit("abbreviation").alias("kind"), "word", F.col("stops").alias("n"), score).union(
        model["starters"].select(F.lit("starter"), "word", F.col("starts"), score)
    )


def learnt_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence of all texts, with ends as learnt."""
    docs = _abbreviated(spark, sf)
    return segment.sentences(docs, "doc_id", "text", segment.learn(docs, "text")).drop("seq")


def _short_sql(c: str) -> str:
    for word, short in SHORT.items():
        c = f"replace({c}, ' {word} ', ' {short} ')"
    return c


_WORDS = rf"""toks AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array({_short_sql("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda t: t <> ''),
    lambda t: regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[("''\[]+|[)"''\],;:]+$', '', 'g')) AS t FROM documents),
  seen AS (SELECT regexp_replace(k, '\.$', '') AS word, suffix(k, '.') AS stop, regexp_matches(k, '[!?]$') AS mark, regexp_replace(x, '\.$', '') AS next
    FROM (SELECT unnest(t) AS k, unnest(list_append(t[2:], NULL)) AS x FROM toks)),
  counts AS (SELECT word, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE stop) AS DOUBLE) AS stops FROM seen GROUP BY 1),
  tot AS (SELECT sum(n) AS a, sum(stops) AS p FROM counts),
  cand AS (SELECT word, stops, n - stops AS bare, length(word) - length(replace(word, '.', '')) AS dots, length(replace(word, '.', '')) AS size
    FROM counts WHERE stops > 0 AND regexp_matches(word, '\p{{L}}') AND NOT regexp_matches(word, '[0-9]')),
  scored AS (SELECT word, stops, bare, 2 * (stops * (ln(0.99) - ln(p / a)) + bare * (ln(0.01) - ln(1 - p / a))) * exp(-size) * (dots + 1) * pow(CAST(size AS DOUBLE), -bare) AS score FROM cand, tot),
  abbr AS (SELECT * FROM scored WHERE score >= 0.3),
  ends AS (SELECT next FROM seen WHERE next IS NOT NULL AND (mark OR stop AND word NOT IN (SELECT word FROM abbr))),
  st AS (SELECT next AS word, CAST(count(*) AS DOUBLE) AS ab FROM ends GROUP BY 1),
  brk AS (SELECT sum(ab) AS s FROM st),
  x AS (SELECT st.word, ab, n AS b, s, a FROM st JOIN counts ON st.word = counts.word, brk, tot WHERE regexp_matches(st.word, '\p{{L}}') AND ab * a > n * s),
  ll AS (SELECT word, ab, -2 * (ab * ln(b / a) + (s - ab) * ln(1 - b / a) + (b - ab) * ln(b / a) + (a - s - b + ab) * ln(1 - b / a)
    - ab * ln(ab / s) - CASE WHEN s = ab THEN 0 ELSE (s - ab) * ln(1 - ab / s) END
    - CASE WHEN b = ab THEN 0 ELSE (b - ab) * ln((b - ab) / (a - s)) END - (a - s - b + ab) * ln(1 - (b - ab) / (a - s))) AS score FROM x)"""
ENDS_SQL = f"""WITH {_WORDS} SELECT 'abbreviation' AS kind, word, stops AS n, round(score, 4) AS score FROM abbr
  UNION ALL SELECT 'starter', word, ab, round(score, 4) FROM ll WHERE score >= 30"""


def _periods(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of equal word sets of each language's documents, a hundred ids being a period."""
    docs = _docs(spark, sf).select("lang", F.expr("doc_id div 100").alias("period"), "doc_id", similar.word_set(F.col("text")).alias("w"))
    return similar.classes(docs, "lang", "period", "doc_id", F.col("w"))


def similar_links(spark: SparkSession, sf: str) -> DataFrame:
    found = similar.links(_periods(spark, sf))
    return found.select(F.col("owner").alias("lang"), "period", F.col("key_a").alias("earlier"), F.col("key_b").alias("later"), "copies_a", "copies_b", "n_a", "n_b", "shared")


def similar_evolution(spark: SparkSession, sf: str) -> DataFrame:
    sets = _periods(spark, sf)
    return similar.evolution(sets, similar.links(sets)).select(F.col("owner").alias("lang"), "period", F.col("key").alias("doc_id"), "copies", "link")


_SETS = r"""d AS (SELECT doc_id, lang, doc_id // 100 AS period, list_sort(list_distinct(list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w FROM documents),
  sets AS (SELECT lang, period, w, min(doc_id) AS doc_id, count(*) AS copies, CAST(len(w) AS INTEGER) AS n FROM d WHERE len(w) > 0 AND lang IS NOT NULL GROUP BY 1, 2, 3),
  met AS (SELECT b.lang, b.period, a.doc_id AS earlier, b.doc_id AS later, a.copies AS copies_a, b.copies AS copies_b, a.n AS n_a, b.n AS n_b,
    CAST(len(list_intersect(a.w, b.w)) AS INTEGER) AS shared FROM sets a JOIN sets b ON a.lang = b.lang AND b.period = a.period + 1),
  linked AS (SELECT * FROM met WHERE 100 * shared >= 80 * (n_a + n_b - shared))"""
SIMILAR_SQL = f"WITH {_SETS} SELECT * FROM linked"
EVOLUTION_SQL = f"""WITH {_SETS}, ends AS (SELECT lang, max(period) AS last FROM sets GROUP BY 1)
  SELECT lang, period, doc_id, copies, CASE WHEN EXISTS (SELECT 1 FROM linked l WHERE l.lang = s.lang AND l.period = s.period AND l.later = s.doc_id) THEN 'PERSISTED_TO' ELSE 'EMERGED_IN' END AS link FROM sets s
  UNION ALL SELECT s.lang, period + 1, doc_id, copies, 'RESOLVED_IN' FROM sets s JOIN ends ON s.lang = ends.lang
  WHERE period < last AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.lang = s.lang AND l.period = s.period + 1 AND l.earlier = s.doc_id)"""


def vector_ann(spark: SparkSession, sf: str) -> DataFrame:
    """About the ten nearest rows of every twentieth one, by an index that reads three quarters of its lists for a query.

    These vectors lie alike in all directions, so neighbours share few lists; where they gather, the index's own share does.
    """
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = ann.Index(spark, f"{shared_dir(spark)}/vector_ann-{uuid.uuid4().hex}").build(e, "vec_id", "embedding")
    return index.search(_queries(e), "vec_id", "embedding", 10, share=0.75).select("query", F.col("id").alias("vec_id"), "score", "rank")


TOPK_SQL = """SELECT query, vec_id, round(s, 3) AS score FROM (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rn
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0{0}) WHERE rn <= 10"""


def vector_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 rows under a filter, unranked."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")
    return vectors.fetched(e, {"label": {"$gte": 3, "$lte": 5}}, 50)


FETCH_SQL = "SELECT vec_id AS id, label FROM embeddings WHERE label BETWEEN 3 AND 5 ORDER BY vec_id LIMIT 50"


def _lines(c):
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def sentence_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks between each document and the one before it in its source, over ids first; texts are joined to the pairs."""
    docs = _docs(spark, sf)
    pairs = diff.adjacent(docs.select("source", "doc_id"), "source", "doc_id").select("latest", "previous")
    for side in ("latest", "previous"):
        pairs = pairs.join(docs.select(F.col("doc_id").alias(side), _lines(F.col("text")).alias(f"{side}_lines")), side)
    keyed = pairs.select(F.col("latest").alias("doc_id"), F.col("previous_lines").alias("previous"), F.col("latest_lines").alias("latest"))
    return diff.with_severity(diff.blocks(keyed, "doc_id"))


def delta_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Stats and gravest change of each pair of neighbouring documents."""
    found = stage(sentence_diff(spark, sf), "blocks")
    top = diff.top_changes(found, "doc_id", most=1).select("doc_id", F.col("type").alias("top_type"), "why")
    return diff.stats(found, "doc_id").join(top, "doc_id", "left")


def sentence_set_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Lines added and removed between neighbouring documents of a source, as sets."""
    docs = _docs(spark, sf)
    pairs = diff.adjacent(docs.select("source", "doc_id"), "source", "doc_id").select("latest", "previous")
    for side in ("latest", "previous"):
        pairs = pairs.join(docs.select(F.col("doc_id").alias(side), F.array_distinct(_lines(F.col("text"))).alias(f"{side}_lines")), side)
    n = lambda a, b: F.size(F.array_except(f"{a}_lines", f"{b}_lines")).cast("long")
    return pairs.select("latest", "previous", n("latest", "previous").alias("added"), n("previous", "latest").alias("removed"))


SET_DIFF_SQL = """WITH p AS (SELECT source, doc_id AS latest, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS previous FROM documents WHERE source IS NOT NULL),
  l AS (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM documents)
  SELECT latest, previous, len(list_filter(a.s, lambda x: NOT list_contains(b.s, x))) AS added, len(list_filter(b.s, lambda x: NOT list_contains(a.s, x))) AS removed
  FROM p JOIN l a ON a.doc_id = latest JOIN l b ON b.doc_id = previous"""


def event_windows_sliding(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    return windows.sliding(events, "ts", "event_type", "2 days", "1 day").select(F.col("window.start").cast("date").alias("day"), F.col("event_type").alias("category"), "events")


SLIDING_SQL = """SELECT CAST(d AS DATE) AS day, event_type AS category, count(*) AS events FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1, 2"""


def competitor_components(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of one nation, each linked to the next by number: connected components of deep chains."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("dst"), "s_nationkey")
    chain = s.withColumn("src", F.lag("dst").over(graph.ordered("s_nationkey", "dst")))
    return graph.components(chain.select(F.coalesce("src", "dst").alias("src"), "dst"))


COMPONENTS_SQL = "SELECT s_suppkey AS node, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS component FROM supplier"


def conversation_markdown(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.read.parquet(f"{sf}/conversations.parquet").withColumnRenamed("text", "content")
    return chat.markdown(m, "conv_id", "turn").select("conv_id", F.md5("text").alias("digest"))


MARKDOWN_SQL = """SELECT conv_id, md5(string_agg(CASE WHEN role = 'user' THEN '**You**' ELSE '**Assistant**' END || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1"""


def prompt_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of a conversation in batches of four, as lines of a prompt."""
    m = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("sentence_id", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    out = chat.batches(m, "conv_id", "turn", 4)
    return out.select("conv_id", F.col("batch").cast("long"), F.md5("lines").alias("digest"))


BATCHES_SQL = """SELECT conv_id, (rn - 1) // 4 AS batch, md5(string_agg('[' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) || '] ' || text, chr(10) ORDER BY turn)) AS digest
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY 1, 2"""

TEXT = {
    "forward_looking_pct": (forward_looking_pct, FORWARD_SQL),
    "severity_scoring": (severity_scoring, SEVERITY_SQL),
    "overall_severity": (overall_severity, OVERALL_SQL),
    "reasons": (reasons, REASONS_SQL),
    "clean_text": (clean_text, CLEAN_SQL),
    "html_strip": (html_strip, None),
    "sentence_segmentation": (sentence_segmentation, None),
    "sentence_ids": (sentence_ids, None),
    "slugify_names": (slugify_names, SLUG_SQL),
    "glossary_extract": (glossary_extract, GLOSSARY_SQL),
    "glossary_merge": (glossary_merge, MERGE_SQL),
    "glossary_upsert": (glossary_upsert, MERGE_SQL),
    "domain_tags": (domain_tags, TAGS_SQL),
    "corpus_trend": (corpus_trend, TREND_SQL),
    "pct_histogram": (pct_histogram, HISTOGRAM_SQL),
    "word_counts": (word_counts, WORDS_SQL),
    "metric_stubs": (metric_stubs, None),
    "sql_sentences": (sql_sentences, SENTENCES_SQL),
    "sql_amounts": (sql_amounts, AMOUNTS_SQL),
    "entity_extraction": (entity_extraction, None),
    "learnt_names": (learnt_names, None),
    "vector_topk": (vector_topk, TOPK_SQL.format("")),
    "vector_topk_filtered": (vector_topk_filtered, TOPK_SQL.format(" AND e.label IN (1, 2)")),
    "vector_ann": (vector_ann, None),
    "run_metrics": (run_metrics, RUN_METRICS_SQL),
    "latent_topk": (latent_topk, None),
    "glossary_lookup": (glossary_lookup, None),
    "sentence_end_model": (sentence_end_model, ENDS_SQL),
    "learnt_sentences": (learnt_sentences, None),
    "similar_links": (similar_links, SIMILAR_SQL),
    "similar_evolution": (similar_evolution, EVOLUTION_SQL),
    "vector_fetch": (vector_fetch, FETCH_SQL),
    "sentence_diff": (sentence_diff, None),
    "delta_stats": (delta_stats, None),
    "sentence_set_diff": (sentence_set_diff, SET_DIFF_SQL),
    "event_windows_sliding": (event_windows_sliding, SLIDING_SQL),
    "competitor_components": (competitor_components, COMPONENTS_SQL),
    "conversation_markdown": (conversation_markdown, MARKDOWN_SQL),
    "prompt_batches": (prompt_batches, BATCHES_SQL),
}
