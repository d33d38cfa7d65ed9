"""Quality rules with cutoffs whose false rejections are bounded, stratum by stratum.

A document's badness is the largest of its signals, and a stratum rejects from a cutoff on. On
labelled documents an exact binomial test, at a level divided among the strata (Bonferroni), asks
whether the share of good documents rejected can exceed the limit. Rejections only grow as a cutoff
falls, so the cutoffs that pass form an unbroken run from the most lenient one (a fixed sequence
needs no further correction), and any of them may be taken; taken is the one that rejects most
labelled junk net of good documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.minhash import P1, mix
from ledgerloom.llm.shared import stage

#: Signals in thousandths: symbols a word, repeated lines, words in repeated windows, capitals among ASCII letters, exclamation marks a word.
SIGNALS = ("symbols", "repeated_lines", "repeated_words", "capitals", "exclaims")
LIMIT, LEVEL = 0.02, 0.05
WHITE = " \t\n\x0b\x0c\r"
#: Strata whose cutoffs are sent to all executors at most; beyond it the join shuffles.
BROADCAST_STRATA = 10_000

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[list(b"#*$%&|<>")] = 2
_KIND[65:91] = 3
_KIND[97:123] = 4
_KIND[33] = 5


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the signals of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    _, white, symbols, upper, lower, exclaims, *_ = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=6).tolist()
    lines = [x for x in (text or "").split("\n") if x.strip(WHITE)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        h = mix((w[:-2] * P1 + w[1:-1]) * P1 + w[2:])
        _, at, times = np.unique(h, return_inverse=True, return_counts=True)
        again = times[at] > 1
        mark = np.zeros(n, bool)
        for k in range(3):
            mark[k : n - 2 + k] |= again
        repeat = int(mark.sum())
    part = lambda a, b: min(1000, 1000 * a // b) if b else 0
    signals = part(symbols, n), part(dup, len(lines)), part(repeat, n), part(upper, upper + lower), part(exclaims, n)
    return n, len(text or "") - white, symbols, dup, repeat, *signals


def features(docs: DataFrame, stratum: str) -> DataFrame:
    """The measures of each document, with its stratum."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *SIGNALS]
    # strata are marked, so that none is like a value
    of = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null"))
    rows = docs.select(F.col("doc_id").cast("long"), of.alias("stratum"), F.col("text").cast("string"))

    def run(batches):
        for b in batches:
            found = np.array([measure(t.as_py()) for t in b.column(2)], np.int64).reshape(-1, len(names))
            digests = pa.array([xxhash.xxh128_digest(t.as_py() or "") for t in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), digests, *(pa.array(c) for c in found.T)], names=["doc_id", "stratum", "digest", *names])

    out = rows.mapInArrow(run, "doc_id long, stratum string, digest binary, " + ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "badness": F.greatest(*SIGNALS)})


def most_failures(n: int, limit: float, level: float) -> int:
    """The most failures of n at which a share of at least limit is rejected at this level; -1 if none.

    The exact test: P(X <= k) <= level for X binomial with n trials and chance limit.
    """
    below, k = 0.0, -1
    for i in range(n + 1):
        below += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(limit) + (n - i) * math.log1p(-limit))
        if below > level:
            break
        k = i
    return k


def cutoffs(labelled: DataFrame, limit: float = LIMIT, level: float = LEVEL, least: int = 20) -> DataFrame:
    """stratum and its cutoff (null: it rejects nothing) from rows with stratum, quality and badness, a row a trial.

    Of the cutoffs that the test allows, that with the largest number of junk rows rejected less
    least times the good ones is taken; the bound holds for whichever is.
    What reaches a task is a histogram of 1001 bins for a stratum.
    """
    counts = labelled.groupBy("stratum", "badness")
    counts = counts.agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad"))
    counts = stage(counts, "histograms")
    tests = max(1, counts.select("stratum").distinct().count())

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(1002, np.int64), np.zeros(1002, np.int64)
        good[pdf["badness"]], bad[pdf["badness"]] = pdf["good"], pdf["bad"]
        most = most_failures(int(good.sum()), limit, level / tests)
        lost, caught = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
        gain = np.where(lost <= most, caught - least * lost, -1)[1:1001]
        cutoff = int(1000 - gain[::-1].argmax()) if gain.max() > 0 else None
        return pd.DataFrame({"stratum": pdf["stratum"].iloc[:1], "cutoff": pd.array([cutoff], "Int64")})

    return counts.groupBy("stratum").applyInPandas(choose, "stratum string, cutoff long")


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row a document: doc_id, n_words, the base counts, base_failed, kept, the signals, badness and cutoff.

    labels(doc_id, quality): 1 is good; rows without either are ignored and of several the least
    counts. The holdout of a stratum is the distinct texts of its labelled documents that the base
    rule passes: a copy is no trial of its own. A null
    text has no words and fails the base rule; a null stratum is one of its own; a null doc_id has
    no label; repeated rows are judged each. A stratum without enough labels rejects by the base
    rule alone.
    """
    found = stage(features(docs, stratum), "features")
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    # a trial is a distinct text of a stratum, so that copies don't count as independent; a text labelled both ways is junk
    trials = found.where("NOT base_failed").join(marks, "doc_id").groupBy("stratum", "digest").agg(F.min("quality").alias("quality"), F.min("badness").alias("badness"))
    chosen = stage(cutoffs(trials), "cutoffs")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_STRATA else chosen
    out = found.join(chosen, "stratum", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("badness") < F.col("cutoff"), F.lit(True))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select(*names, kept.alias("kept"), *SIGNALS, "badness", "cutoff")


def op5_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judged(docs, labels)
