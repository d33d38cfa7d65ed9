"""Benchmark decontamination by winnowing, in DataFrame expressions alone.

The fingerprint of a window of words is the least hash of the k-grams in it. Windows of
k + w - 1 words with equal words have equal fingerprints, so every shared span of that length is
found; what the join of fingerprints proposes is then extended to windows compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stage

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter that fingerprints of the documents pass before the join.
FILTER_BITS = 1 << 20
#: Rows of the benchmark's side that are sent to all executors at most; beyond it joins shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Runs of digits, letters a-z after lower-casing A-Z, and all characters beyond ASCII."""
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once: a lambda's variable isn't expanded where it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(w: Column, k: int) -> Column:
    """Hashes of all k-grams of the words w, a column or variable; empty if there are fewer words."""
    return F.when(F.size(w) < k, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(k)]))
    )


def fingerprints(w: Column, k: int, n: int) -> Column:
    """The least of each n consecutive hashes of k-grams of the words w, by window."""
    least = lambda g: F.when(F.size(g) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(g) - n + 1, F.lit(1))), lambda i: F.least(*[F.element_at(g, i + j) for j in range(n)]))
    )
    return let(grams(w, k), least)


def _runs(n: int) -> Callable[[Column], Column]:
    """All runs of n words, each joined by blanks; none if there are fewer words."""

    def runs(v: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(v) - n + 1, F.lit(1)))
        return F.when(F.size(v) < n, F.array().cast("array<string>")).otherwise(F.transform(at, lambda i: F.array_join(F.slice(v, i, n), " ")))

    return runs


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _bitmap(prints: DataFrame) -> np.ndarray:
    """A filter over the prints as FILTER_BITS / 64 numbers: of one size whatever the prints."""
    at, bit = F.floor(F.pmod("print", F.lit(FILTER_BITS)) / 64).cast("int"), F.expr("shiftleft(1L, CAST(pmod(print, 64) AS INT))")
    by = prints.select(at.alias("at"), bit.alias("bit"))
    held = {r["at"]: r["bits"] for r in by.groupBy("at").agg(F.expr("bit_or(bit)").alias("bits")).collect()}
    return np.array([held.get(i, 0) for i in range(FILTER_BITS // 64)], np.int64)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, item_ids, items_sha256, contaminated.

    A window is window consecutive words of an item; an item of fewer words, but not none, is one
    window. Document words inside any occurrence of a window are hit. Null and empty texts have no
    words. Rows with one doc_id and text are one document to search and each is returned; a null
    doc_id is kept; a null item_id has windows but isn't listed or counted.
    """
    spark = docs.sparkSession
    w = window - k + 1
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string"), F.length("text").cast("string"))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("key", key)

    # items: each distinct window with its items
    item = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    item = item.select("item_id", F.explode(F.transform(at, lambda i: F.slice("w", i, window))).alias("w"))
    windows = stage(item.select("item_id", F.size("w").alias("length"), F.array_join("w", " ").alias("words")).distinct(), "windows")
    full = windows.where(F.col("length") == window)
    prints = stage(full.select(F.array_min(let(F.split("words", " "), lambda v: grams(v, k))).alias("print")).distinct(), "prints")
    lengths = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    n_prints = prints.count()

    # documents: fingerprints that the filter lets through, few of them
    bits = F.lit(_bitmap(prints))
    passes = lambda m: F.getbit(F.element_at(bits, (F.shiftrightunsigned(F.pmod(m, F.lit(FILTER_BITS)), 6) + 1).cast("int")), F.pmod(m, F.lit(64)).cast("int")) == 1
    short = [n for n in sorted(lengths) if n < window]
    scan = lambda v: F.struct(
        F.size(v).cast("long").alias("n"),
        (F.array_distinct(F.filter(fingerprints(v, k, w), passes)) if n_prints else F.array().cast("array<bigint>")).alias("prints"),
    )
    scanned = docs.select("doc_id", "key", let(words(F.col("text")), scan).alias("x"))
    scanned = stage(scanned.select("doc_id", "key", F.col("x.n").alias("n_words"), "x.prints"), "scanned")
    hits = scanned.select("key", F.explode("prints").alias("print")).join(_small(prints, n_prints), "print")
    matched = hits.groupBy("key").agg(F.collect_set("print").alias("matched"))
    matched = stage(matched, "matched")
    n_matched = matched.count()

    # extension: windows of the documents that share a fingerprint, compared as words
    near = docs.join(_small(matched, n_matched), "key")

    def spans_of(v: Column) -> Column:
        hit = lambda m: F.filter(F.sequence(F.lit(1), F.greatest(F.size(m), F.lit(1))), lambda i: F.array_contains("matched", F.element_at(m, i)))
        return F.transform(let(fingerprints(v, k, w), hit), lambda i: F.struct(i.alias("start"), F.array_join(F.slice(v, i, window), " ").alias("words")))

    taken = near.select("key", F.explode(let(words(F.col("text")), spans_of)).alias("x"))
    taken = taken.select("key", "x.start", F.lit(window).alias("length"), "x.words")
    for n in short:
        own = _small(windows.where(F.col("length") == n).select("words").distinct(), lengths[n])
        here = docs.select("key", F.posexplode(let(words(F.col("text")), _runs(n))).alias("at", "words"))
        here = here.join(own, "words", "left_semi").select("key", (F.col("at") + 1).alias("start"), F.lit(n).alias("length"), "words")
        taken = taken.union(here)
    distinct = windows.select("length", "words").distinct()
    occurs = taken.distinct().join(_small(distinct, sum(lengths.values())), ["length", "words"], "left_semi")
    occurs = stage(occurs, "occurrences")

    # the union of a document's hit spans, and the items of its distinct windows
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    cover = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to")),
        lambda acc: acc["n"],
    )
    n_hit = occurs.groupBy("key").agg(cover.alias("n_hit"))
    of = occurs.select("key", "length", "words").distinct().join(_small(windows, sum(lengths.values())), ["length", "words"])
    of = of.groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    result = stage(n_hit.join(of, "key"), "hits")
    none = F.array().cast("array<string>")
    out = scanned.join(result, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids")
    )
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop("item_ids")


OP7_SQL = r"""
WITH iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
ip AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM ip),
dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dp),
occ AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN win ON dg.s = win.s AND dg.n = win.n),
hitw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM occ) GROUP BY 1)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hitw USING (doc_id) LEFT JOIN its USING (doc_id)
"""
