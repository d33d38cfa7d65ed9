"""Sentence ends learnt from the texts themselves: abbreviations, words that start sentences, and pairs that no sentence parts.

All three are log-likelihood tests over counts of the corpus (Kiss and Strunk, 2006). The plain rule
proposes ends; what was learnt takes back those after abbreviations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as texts
from ledgerloom.shared import stage

#: Least scores of an abbreviation, a sentence starter and a collocation, as published.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: Rows of what was learnt that go to all executors at most; beyond it the joins shuffle.
BROADCAST_ROWS = 200_000
WHITE = r"[\x20\x09-\x0D]+"
EDGES = r"""^[("'\[]+|[)"'\],;:]+$"""
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def kind(token: Column) -> Column:
    """A token in lower case (A-Z) without quotes, brackets and commas round it."""
    return F.regexp_replace(F.translate(token, UPPER, UPPER.lower()), EDGES, "")


def _bare(word: Column) -> Column:
    """Without its last full stop."""
    return F.regexp_replace(word, r"\.$", "")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def occurrences(df: DataFrame, text: str) -> DataFrame:
    """word, stop, mark, next and n: how often a token's kind without the last full stop is met, whether it has one, or ends with ! or ?, and the next token's word, null but after such ends.

    Tokens are counted as they are written; only those that differ are looked at, and only those with a possible end go with the next.
    """
    tokens = df.select(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WHITE), "").alias("t"))
    rows = tokens.select(F.inline(F.arrays_zip("t", F.slice("t", F.lit(2), F.size("t"))))).toDF("k", "x")
    rows = rows.select("k", F.when(texts.holds_any(F.col("k"), ".!?"), F.col("x")).alias("x")).groupBy("k", "x").agg(F.count("*").alias("n"))
    rows = rows.select(kind(F.col("k")).alias("k"), kind(F.col("x")).alias("x"), "n")
    stop, mark = F.col("k").endswith("."), F.col("k").rlike("[!?]$")
    rows = rows.select(_bare(F.col("k")).alias("word"), stop.alias("stop"), mark.alias("mark"), F.when(stop | mark, _bare(F.col("x"))).alias("next"), "n")
    return rows.groupBy("word", "stop", "mark", "next").agg(F.sum("n").alias("n"))


def _together(a: str, b: str, ab: str, n: float) -> Column:
    """Log-likelihood ratio that b comes after a otherwise than by chance: counts of a, of b, of both, of all."""
    part = lambda k, m, p: f"(CASE WHEN {k} = 0 THEN 0 ELSE ({k}) * ln({p}) END + CASE WHEN {m} = 0 THEN 0 ELSE ({m}) * ln(1 - ({p})) END)"
    p, p1, p2 = f"{b} / {n}", f"{ab} / {a}", f"({b} - {ab}) / ({n} - {a})"
    rest = f"({n} - {a} - {b} + {ab})"
    return F.expr(f"-2 * ({part(ab, f'({a} - {ab})', p)} + {part(f'({b} - {ab})', rest, p)} - {part(ab, f'({a} - {ab})', p1)} - {part(f'({b} - {ab})', rest, p2)})")


def learn(df: DataFrame, text: str) -> dict[str, DataFrame]:
    """abbreviations(word, stops, bare, score), starters(word, starts, score) and collocations(word, next, times, score) of a corpus; staged.

    An abbreviation has a letter and no digit, and nearly always a full stop; the shorter and the
    more of these inside, the likelier. A starter is met after ends of sentences more often than by
    chance, a collocation is an abbreviation and the word met after it more often than by chance.
    Null and empty texts have no tokens; a corpus without full stops teaches nothing.
    """
    seen = stage(occurrences(df, text), "occurrences")
    times = lambda c="n": F.coalesce(F.sum(c), F.lit(0)).cast("double")
    counts = stage(seen.groupBy("word").agg(times().alias("n"), times(F.when(F.col("stop"), F.col("n"))).alias("stops")), "word_counts")
    n, stops = counts.agg(F.sum("n"), F.sum("stops")).first()
    n, stops = float(n or 0), float(stops or 0)
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    rows = counts.where((F.col("stops") > 0) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike("[0-9]"))
    rows = rows.select("word", "stops", (F.col("n") - F.col("stops")).alias("bare"), inner.alias("inner"), (F.length("word") - inner).alias("size"))
    chance = f"{stops / n if n else 0.0}"
    likely = F.expr(f"2 * (stops * (ln(0.99D) - ln({chance}D)) + bare * (ln(0.01D) - ln(1 - {chance}D)))")
    scored = rows.withColumn("score", likely * F.exp(-F.col("size")) * (F.col("inner") + 1) * F.pow(F.col("size").cast("double"), -F.col("bare")))
    of = scored.where(F.col("score") >= ABBREVIATION) if 0 < stops < n else scored.where("false")
    abbreviations = stage(of.select("word", "stops", "bare", "score"), "abbreviations")
    near = _small(abbreviations.select("word"))

    followed = seen.where("next IS NOT NULL")
    ends = followed.where("mark").unionByName(followed.where("stop AND NOT mark").join(near, "word", "left_anti"))
    starts = stage(ends.groupBy(F.col("next").alias("word")).agg(times().alias("starts")), "starts")
    breaks = float(starts.agg(F.sum("starts")).first()[0] or 0)
    both = starts.join(counts, "word").where(F.col("word").rlike(r"\p{L}"))
    score = _together(f"{breaks}D", "n", "starts", f"{n}D")
    starters = both.where(f"starts * {n}D > n * {breaks}D").withColumn("score", score).where(F.col("score") >= STARTER)

    pair = followed.where("stop").join(near, "word", "left_semi").groupBy("word", "next").agg(times().alias("times"))
    pair = pair.where("times > 1").join(counts.select("word", F.col("n").alias("a")), "word").join(counts.select(F.col("word").alias("next"), F.col("n").alias("b")), "next")
    pair = pair.where(f"times * {n}D > a * b").withColumn("score", _together("a", "b", "times", f"{n}D")).where(F.col("score") >= COLLOCATION)
    return {
        "abbreviations": abbreviations,
        "starters": stage(starters.select("word", "starts", "score"), "starters"),
        "collocations": stage(pair.select("word", "next", "times", "score"), "collocations"),
    }


def _between(parts: Column) -> Column:
    """j, last and first of each end between parts j and j + 1 of a paragraph: the last token before it, the first after it.

    A part that another follows ends with its last token, and one that follows another begins with its first.
    """
    last = lambda x: F.regexp_extract(F.substring_index(x, " ", -1), r"(\S+)$", 1)
    first = lambda x: F.regexp_extract(F.substring_index(x, " ", 1), r"^(\S+)", 1)
    pair = lambda x, j: F.struct(j.alias("j"), last(x).alias("last"), first(F.get(parts, j + 1)).alias("first"))
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), pair)


def sentences(df: DataFrame, key: str, text: str, model: dict[str, DataFrame], least: int = 3) -> DataFrame:
    """key, seq, paragraph_index, sentence_index, text and word_count of each sentence of least words or more.

    Ends are those of the plain rule, but for ends after an abbreviation, or after a single letter
    with a full stop, unless a starter follows, and for those within a collocation. Parts that are
    put together again have a blank between them. Rows that repeat a key are texts of their own.

    A paragraph's parts stay in its row: only the words round its ends are looked up, and the ends taken back come to the row.
    """
    ids = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"), F.monotonically_increasing_id().alias("row"))
    rows = ids.select("key", "row", F.posexplode(texts.paragraphs(F.col("t"))).alias("paragraph_index", "p"))
    rows = rows.select("key", "row", "paragraph_index", F.split("p", texts.SENTENCE_END).alias("parts"))
    rows = stage(rows.withColumns({"ends": _between(F.col("parts")), "id": F.monotonically_increasing_id()}), "parts")
    at = rows.select("id", F.inline("ends")).where(F.col("last").endswith("."))
    at = at.select("id", "j", _bare(kind(F.col("last"))).alias("word"), _bare(kind(F.col("first"))).alias("next"))
    flag = lambda name: F.lit(True).alias(name)
    at = at.join(_small(model["abbreviations"].select("word", flag("short"))), "word", "left")
    at = at.where(F.col("short").isNotNull() | F.col("word").rlike(r"^\p{L}$"))
    at = at.join(_small(model["starters"].select(F.col("word").alias("next"), flag("starts"))), "next", "left")
    at = at.join(_small(model["collocations"].select("word", "next", flag("pair"))), ["word", "next"], "left")
    held = at.where(F.col("starts").isNull() | F.col("pair").isNotNull()).groupBy("id").agg(F.collect_list("j").alias("held"))
    rows = rows.drop("ends").join(held, "id", "left")
    # the last part of each sentence; F.array() holds no j
    upto = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.coalesce("held", F.array().cast("array<int>")))
    rows = rows.select("key", "row", "paragraph_index", "parts", upto.alias("upto"))
    before = lambda k: F.coalesce(F.get("upto", k - 1) + 1, F.lit(0))
    whole = F.transform("upto", lambda j, k: F.array_join(F.slice("parts", before(k) + 1, j - before(k) + 1), " "))
    # counted before the rows are parted, else the filter counts again
    counted = F.transform(whole, lambda s: F.struct(s.alias("text"), texts.word_count(s).alias("word_count")))
    out = rows.select("key", "row", "paragraph_index", F.posexplode(counted).alias("sentence_index", "s"))
    out = out.select("key", "row", "paragraph_index", "sentence_index", "s.*").where(F.col("word_count") >= least)
    seq = F.row_number().over(Window.partitionBy("row").orderBy("paragraph_index", "sentence_index")) - 1
    return out.select(F.col("key").alias(key), seq.alias("seq"), "paragraph_index", "sentence_index", "text", "word_count")
