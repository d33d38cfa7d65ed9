"""Which sources of a language use words unlike the others: divergence of pairs, and each source's own terms.

Counts of terms become probabilities in parts of 10**9, by whole-number arithmetic. A source's most
divergent terms are found by upper bounds: its terms of one count have one probability, and of
these the one rarest in the language has the largest divergence. Pairs of sources are summed from
the terms' postings; terms that one or both of a pair lack are counted, not listed.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import drop, stage

#: Documents of its language that a kept term occurs in at least, and ranks listed of a group's terms.
LEAST_DOCS, RANKS = 10, 10
#: Terms that a task counts before it hands them on; rows of a batch that it hands on.
HELD, ROWS = 400_000, 50_000
#: Rows of a table sent to all executors at most; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
#: Bytes that end a term become blanks, A-Z become a-z, and those beyond ASCII stay.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents that have the term, in parts of the input.

    Each group of a part has one row with a null term besides.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def flush(groups):
        rows = [[] for _ in schema]

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)
            for x in rows:
                x.clear()
            return out

        for (lang, source), (n, having) in groups.items():
            for term in (None, *n):
                values = (lang, source, term if term is None else term.decode("utf-8"), n.get(term, 0), having.get(term, 0))
                for x, value in zip(rows, values):
                    x.append(value)
                if len(rows[0]) == ROWS:
                    yield batch()
        yield batch()

    def run(batches):
        groups, held = {}, 0
        for b in batches:
            for text, lang, source in zip(*(b.column(k) for k in range(3))):
                n, having = groups.setdefault((lang.as_py() or "", source.as_py() or ""), (Counter(), Counter()))
                terms = (text.as_py() or "").encode("utf-8").translate(_TERMS).split()
                before = len(n)
                n.update(terms)
                having.update(set(terms))
                held += len(n) - before
                if held > HELD:
                    yield from flush(groups)
                    groups, held = {}, 0
        yield from flush(groups)

    rows = docs.select(*(F.col(c).cast("string") for c in ("text", "lang", "source")))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str) -> Column:
    """1 + floor(10**9 * (n + 2) / total), in two divisions that stay whole up to totals of 2.8e14."""
    first = f"(({n} + 2) * 31250L)"
    return F.expr(f"1L + ({first} div {total}) * 32000L + (({first} % {total}) * 32000L) div {total}")


def unlike(p: str, q: str) -> str:
    """floor((p - q)**2 / (p + q))"""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def _small(df: DataFrame) -> DataFrame:
    """A staged table, sent to all executors if it is small by count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: by group the other sources of its language, and its own most divergent terms.

    Terms are runs of letters A-Z, in lower case, and of characters beyond ASCII; a language keeps
    those in at least least_docs of its documents. Part `pair` has each other source of the
    language with the sum over all kept terms, part `term` the group's terms that are likelier there
    than in the language, to rank ranks; equal values rank by item. Null texts, languages and
    sources are empty strings. A group without terms is compared too. Rows that repeat a doc_id are
    documents of their own; the doc_id and other columns aren't read. Without documents there are no rows.
    """
    parts = counted(docs)
    counts = stage(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term_counts")
    groups = stage(counts.where("term IS NULL").select("lang", "source", F.monotonically_increasing_id().alias("g")), "groups")
    terms = counts.where("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least_docs)
    kept = stage(kept.select("lang", "term", "all_n", F.monotonically_increasing_id().alias("t")), "kept_terms")
    postings = terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]).join(_small(groups), ["lang", "source"])
    postings = stage(postings.select("g", "t", "n", "all_n"), "postings")
    drop(counts)

    langs = kept.groupBy("lang").agg(F.sum("all_n").alias("all_total"), F.count("*").alias("v"))
    own = postings.groupBy("g").agg(F.sum("n").alias("total"))
    facts = groups.join(own, "g", "left").join(langs, "lang", "left")
    v = F.coalesce("v", F.lit(0))
    facts = facts.select("g", "lang", "source", v.alias("v"), (F.coalesce("total", F.lit(0)) + 2 * v).alias("d"), (F.col("all_total") + 2 * v).alias("all_d"))
    facts = stage(facts.withColumn("p0", F.when(F.col("v") > 0, share("0", "d"))), "group_facts")
    near = _small(facts)
    placed = postings.join(near.select("g", "d", "all_d", "p0"), "g").withColumn("p", share("n", "d"))
    buckets = placed.groupBy("g", "n", "d", "all_d", "p").agg(F.count("*").alias("size"), F.min("all_n").alias("rarest"))
    buckets = stage(buckets, "count_buckets")

    return _pairs(facts, placed, buckets).select(COLUMNS).union(_terms(facts, placed, buckets, kept, ranks).select(COLUMNS))


def _pairs(facts: DataFrame, placed: DataFrame, buckets: DataFrame) -> DataFrame:
    """All other sources of each group's language, ranked by the sum over the kept terms.

    As if both lacked every term, the sum is the same for each; what a group's terms change in it
    follows from its counts, and what terms of both change from their postings.
    """
    a, b = (facts.select("lang", *(F.col(c).alias(f"{c}_{x}") for c in ("g", "source", "p0")), *([F.col("v")] if x == "a" else [])) for x in "ab")
    both = a.join(b, "lang").where("g_a < g_b")
    lacking = both.select("g_a", "g_b", F.expr(f"coalesce(v * ({unlike('p0_a', 'p0_b')}), 0)").alias("value"))
    pair = both.select("g_a", "g_b", "p0_a", "p0_b")
    pair = pair.union(pair.select("g_b", "g_a", "p0_b", "p0_a"))
    one = buckets.select(F.col("g").alias("g_a"), "p", "size").join(pair, "g_a")
    one = one.select(
        F.least("g_a", "g_b").alias("g_a"), F.greatest("g_a", "g_b").alias("g_b"), F.expr(f"size * ({unlike('p', 'p0_b')} - {unlike('p0_a', 'p0_b')})").alias("value")
    )
    x, y = (placed.select("t", *(F.col(c).alias(f"{c}_{x}") for c in ("g", "p", "p0"))) for x in "ab")
    met = x.join(y, "t").where("g_a < g_b")
    more = f"({unlike('p_a', 'p_b')}) - ({unlike('p_a', 'p0_b')}) - ({unlike('p0_a', 'p_b')}) + ({unlike('p0_a', 'p0_b')})"
    met = met.select("g_a", "g_b", F.expr(more).alias("value"))
    parts = [x.groupBy("g_a", "g_b").agg(F.sum("value").alias("value")) for x in (one, met)]
    sums = lacking.union(parts[0]).union(parts[1]).groupBy("g_a", "g_b").agg(F.sum("value").alias("value"))
    sums = stage(sums, "pair_sums")
    sums = sums.union(sums.select("g_b", "g_a", "value"))
    of, other = (facts.select(F.col("g").alias(f"g_{x}"), *c) for x, c in (("a", ["lang", "source"]), ("b", [F.col("source").alias("item")])))
    named = sums.join(of, "g_a").join(other, "g_b").withColumn("part", F.lit("pair"))
    order = Window.partitionBy("g_a").orderBy(F.desc("value"), "item")
    return named.withColumn("rank", F.row_number().over(order))


def _terms(facts: DataFrame, placed: DataFrame, buckets: DataFrame, kept: DataFrame, ranks: int) -> DataFrame:
    """Each group's terms that are likelier there than in its language, the first ranks of them.

    Buckets of one count are taken by their bounds, the largest first. A bucket's bound is the value
    of its rarest term, so that of the bucket in place ranks is no larger than the value in place
    ranks, and buckets with strictly smaller bounds have no term to list.
    """
    q = lambda n: share(n, "all_d").alias("q")
    bounds = buckets.select("g", "n", "p", q("rarest")).where("p > q").withColumn("bound", F.expr(unlike("p", "q")))
    first = bounds.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("bound")))).where(F.col("place") <= ranks)
    floor = first.groupBy("g").agg(F.when(F.count("*") == ranks, F.min("bound")).otherwise(0).alias("floor"))
    open_ = stage(bounds.join(floor, "g").where("bound >= floor").select("g", "n", "floor"), "open_buckets")
    seen = placed.select("g", "n", "t", "p", q("all_n")).where("p > q").join(_small(open_), ["g", "n"])
    seen = seen.withColumn("value", F.expr(unlike("p", "q"))).where("value >= floor")
    named = seen.join(kept.select("t", F.col("term").alias("item")), "t")
    named = named.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= ranks)
    return named.join(facts.select("g", "lang", "source"), "g").withColumn("part", F.lit("term"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and terms of every group of the documents; see divergence()."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS l FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3),
counts AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.l FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gt AS (SELECT lang, source, CAST(sum(n) + 2 * count(*) AS HUGEINT) AS d FROM counts GROUP BY 1, 2),
lt AS (SELECT lang, CAST(sum(l) + 2 * count(*) AS HUGEINT) AS d FROM kept GROUP BY 1),
p AS (
  SELECT x.lang, x.source, x.term, x.n, 1 + CAST(1000000000 AS HUGEINT) * (x.n + 2) // gt.d AS p, 1 + CAST(1000000000 AS HUGEINT) * (x.l + 2) // lt.d AS q
  FROM counts x JOIN gt ON x.lang = gt.lang AND x.source = gt.source JOIN lt ON x.lang = lt.lang),
met AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(m.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
