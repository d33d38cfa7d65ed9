"""Names that are no competitors, markets or metrics, and graphs without them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions import text
from ledgerloom.operators import graph


def competitor_noise(name: Column, exact: Iterable[str] = ()) -> Column:
    """Whether a name is in a list (upper case, given by the caller), holds a phrase or matches a pattern."""
    found = text.holds_any(F.lower(F.trim(name)), fixed.COMPETITOR_NOISE_PHRASES) | name.rlike(text.any_of(fixed.COMPETITOR_NOISE_PATTERNS))
    listed = list(exact)
    return F.upper(F.trim(name)).isin(listed) | found if listed else found


def market_noise(name: Column) -> Column:
    """Whether a market's name is none: kept short names first, then phrases, patterns, and all other names of three characters or less."""
    n = F.trim(name)
    garbage = text.holds_any(F.lower(n), fixed.MARKET_NOISE_PHRASES) | n.rlike(text.any_of(fixed.MARKET_NOISE_PATTERNS)) | (F.length(n) <= 3)
    return F.when(F.upper(n).isin(fixed.MARKET_KEPT), False).otherwise(garbage)


def metric_noise(name: Column, strict_reference: bool = False) -> Column:
    """Whether a metric's name is a fragment. strict_reference reads the pattern for lower-case starts whatever the case, so any letter matches."""
    n, low = F.trim(name), F.lower(F.trim(name))
    ends = F.lit(False)
    for p in fixed.METRIC_NOISE_PREFIXES:
        ends = ends | low.startswith(p)
    for s in fixed.METRIC_NOISE_SUFFIXES:
        ends = ends | low.endswith(s)
    patterns = [p if p == "^[a-z]" and not strict_reference else f"(?i:{p})" for p in fixed.METRIC_NOISE_PATTERNS]
    return (F.length(n) <= 3) | ends | n.rlike(text.any_of(patterns))


NOISE: dict[str, Callable[[Column], Column]] = {"Competitor": competitor_noise, "GeographicMarket": market_noise, "FinancialMetric": metric_noise}


def audit(nodes: DataFrame, label: str, most: int = 200) -> DataFrame:
    """The most frequent names of a label, and whether each would go."""
    named = nodes.where((F.col("label") == label) & F.col("name").isNotNull())
    return named.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(most).withColumn("noise", NOISE[label](F.col("name")))


def planned(nodes: DataFrame, label: str, noise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Nodes of a label that a cleaning would delete."""
    return nodes.where((F.col("label") == label) & F.coalesce((noise or NOISE[label])(F.col("name")), F.lit(False)))


def cleaned(nodes: DataFrame, edges: DataFrame, label: str, execute: bool = False, noise: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without a label's noise, or as they are unless told to execute.

    Markets are first merged by their aliases, competitors of one company at most pruned at the end.
    """
    if not execute:
        return nodes, edges
    if label == "GeographicMarket":
        nodes, edges = graph.merge_aliases(nodes, edges, fixed.MARKET_ALIASES, label)
    nodes, edges = graph.detach_delete(nodes, edges, planned(nodes, label, noise).select("node_id"))
    return graph.prune_singletons(nodes, edges) if label == "Competitor" else (nodes, edges)
