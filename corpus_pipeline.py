"""From raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import language, minhash, packing, quality, winnowing
from ledgerloom.llm.shared import stage

#: Keys of dropped rows sent to all executors at most; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def _free(docs: DataFrame, name: str = "_row") -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row's own and the key's name: doc_id, or where any is null or repeated a number written with the rows."""
    key = _free(docs)
    own = F.col("doc_id").cast("long").alias(key)
    odd = docs.select(own).groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))
    if odd.limit(1).isEmpty():
        return docs.select("*", own), key
    return stage(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _by_key(keyed: DataFrame, key: str) -> DataFrame:
    """The key, in place of doc_id, with text and language: for operators that give their verdicts by doc_id."""
    return keyed.select(F.col(key).alias("doc_id"), "text", "lang")


def _without(keyed: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """keyed without the rows whose key is in dropped(doc_id), and without the key."""
    dropped = stage(dropped.select(F.col("doc_id").alias(key)), "dropped")
    small = dropped.count() <= BROADCAST_IDS
    return keyed.join(F.broadcast(dropped) if small else dropped, key, "left_anti").drop(key)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; null texts and those without letters go.

    The model learns from the documents of this stage's input. Each row is told by its own text.
    """
    keyed, key = _keyed(docs)
    found = language.identified(_by_key(keyed, key), language.train(docs))
    return _without(keyed, key, found.where("rejected"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled cutoff keep, each row judged by its own text.

    Rows have the label of their doc_id; those with a null one have none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.min("quality").alias("quality"))
    keyed, key = _keyed(docs)
    ids = keyed.select(F.col("doc_id").cast("long").alias("of"), F.col(key).alias("doc_id"))
    marks = ids.join(labels, "of").select("doc_id", "quality")
    return _without(keyed, key, quality.judged(_by_key(keyed, key), marks).where("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id, a null one last.

    Rows that share a doc_id are documents of their own; of those in one group the one with the
    smallest hash of the text stays. Rows without words are no duplicates of each other.
    """
    keyed, key = _keyed(docs)
    found = minhash.near_duplicates(_by_key(keyed, key)).select("doc_id", "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.xxhash64("text"), F.col(key).alias("key")).alias("place")
    places = keyed.select(F.col(key).alias("row"), order)
    found = stage(found.join(places, F.col("row") == found["doc_id"]).select(found["doc_id"], "component_id", "place"), "groups")
    first = found.groupBy("component_id").agg(F.min("place")["key"].alias("doc_id"))
    return _without(keyed, key, found.join(first, "doc_id", "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark, each row searched for itself."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed, key = _keyed(docs)
    return _without(keyed, key, winnowing.contamination(_by_key(keyed, key), items).where("contaminated"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in packed sequences."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifiers and the packing: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
