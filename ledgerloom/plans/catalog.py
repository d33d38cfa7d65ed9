"""The registered queries, and SQL that gives the same rows."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans.graph_queries import GRAPH_QUERIES
from ledgerloom.plans.relational import STATS
from ledgerloom.plans.text_queries import TEXT

FLAGSHIP = "markets_by_year"


def _sql(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **tables)


_PAIRS = {name: q if isinstance(q, tuple) else (q, q) for name, q in STATS.items()}

_OWN = TEXT | GRAPH_QUERIES
QUERIES = {name: functools.partial(_sql, spark_text) for name, (spark_text, _) in _PAIRS.items()} | {name: f for name, (f, _) in _OWN.items()}

ORACLES = {name: re.sub(r"\{(\w+)\}", r"\1", duck) for name, (_, duck) in _PAIRS.items() if duck} | {name: duck for name, (_, duck) in _OWN.items() if duck}
