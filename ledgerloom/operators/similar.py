"""Links between similar items of consecutive periods: a set-similarity join by rare words first.

Sets that reach a similarity share one of their rarest words, so only those, and only sets of near
sizes, meet in a join; what meets is compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.shared import stage

SIDE = ["c", "key", "copies", "n", "w"]


def word_set(text: Column) -> Column:
    """Distinct words of a text, A-Z in lower case, between ASCII white space."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def classes(items: DataFrame, owner: str, period: str, key: str, words: Column) -> DataFrame:
    """A staged row for each different set of an owner's period: owner, period, c, key, copies, n, w.

    key is the smallest of the items with the set, copies their number. Items without words, owner
    or period are left out.
    """
    rows = items.select(F.col(owner).alias("owner"), F.col(period).cast("long").alias("period"), F.col(key).alias("key"), F.array_sort(words).alias("w"))
    rows = rows.where("owner IS NOT NULL AND period IS NOT NULL AND size(w) > 0")
    rows = stage(rows.select("*", F.sha2(F.to_json("w"), 256).alias("digest"), F.monotonically_increasing_id().alias("row")), "items")
    one = rows.groupBy("owner", "period", "digest").agg(F.min("row").alias("row"), F.min("key").alias("least"), F.count("*").alias("copies"))
    held = rows.select("row", "w").join(one, "row")
    return stage(held.select("owner", "period", F.col("row").alias("c"), F.col("least").alias("key"), "copies", F.size("w").alias("n"), "w"), "classes")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """The rarest words of each set, as many as a set of that similarity must share one of, with their places by rarity."""
    # a set's words travel with its number alone, what else is known of it meets the prefixes
    word = sets.select("c", F.explode("w").alias("word"))
    rare = word.groupBy("word").agg(F.count("*").alias("sets"))
    own = Window.partitionBy("c")
    placed = word.join(rare, "word").withColumns({"p": F.row_number().over(own.orderBy("sets", "word")), "n": F.count("*").over(own)})
    placed = placed.where(f"p <= n - ({percent} * n + 99) div 100 + 1").select("c", "word", "p")
    return placed.join(sets.select("c", "owner", "period", "n"), "c")


def links(sets: DataFrame, percent: int = 80) -> DataFrame:
    """owner, period, both sides' c, key, copies, n, and shared: classes() of an owner's consecutive periods with shared / union of percent or more.

    period is the later one. Equal sets of one period are one class already, so many copies make one
    link. No link is lost: two sets that reach the similarity share a word of both prefixes, and at
    the first such word the words left are enough.
    """
    rows = stage(_prefixes(sets, percent), "prefixes")
    a = rows.select("owner", (F.col("period") + 1).alias("period"), "word", *(F.col(c).alias(f"{c}_a") for c in ("c", "n", "p")))
    b = rows.select("owner", "period", "word", *(F.col(c).alias(f"{c}_b") for c in ("c", "n", "p")))
    need = f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}"
    fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND 1 + least(n_a - p_a, n_b - p_b) >= {need}"
    met = stage(a.join(b, ["owner", "period", "word"]).where(fits).select("owner", "period", "c_a", "c_b").distinct(), "met")
    # only sets that met move once more
    some = stage(sets.join(met.select(F.explode(F.array("c_a", "c_b")).alias("c")).distinct(), "c", "left_semi"), "sets")
    for side in "ab":
        met = met.join(some.select(*(F.col(c).alias(f"{c}_{side}") for c in SIDE)), f"c_{side}")
    met = met.withColumn("shared", F.size(F.array_intersect("w_a", "w_b"))).where(f"100 * shared >= {percent} * (n_a + n_b - shared)")
    return met.select("owner", "period", *(f"{c}_{side}" for side in "ab" for c in SIDE if c != "w"), "shared")


def evolution(sets: DataFrame, found: DataFrame) -> DataFrame:
    """owner, period, key, copies and link of each class: EMERGED_IN its period without a link from the one before, else
    PERSISTED_TO it; and RESOLVED_IN the next period without a link to it, where the owner has that period or a later one.
    """
    own = sets.select("owner", "period", "c", "key", "copies")
    linked = lambda side: found.select(F.col(f"c_{side}").alias("c"), F.lit(True).alias("linked")).distinct()
    come = own.join(linked("b"), "c", "left").select("owner", "period", "key", "copies", F.when(F.col("linked"), "PERSISTED_TO").otherwise("EMERGED_IN").alias("link"))
    last = own.groupBy("owner").agg(F.max("period").alias("last"))
    gone = own.join(linked("a"), "c", "left_anti").join(last, "owner").where("period < last")
    return come.union(gone.select("owner", F.col("period") + 1, "key", "copies", F.lit("RESOLVED_IN")))
