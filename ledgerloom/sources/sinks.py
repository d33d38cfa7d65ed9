"""Writers that can run again: versioned tables with keyed merges, and additions that skip what is there."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions import text
from ledgerloom.operators import glossary, graph
from ledgerloom.shared import BUCKETS, Table, children, delete, exists, get_text, put_text

ORDER = "_seq"


def write_sections(documents: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Add section documents whose source_file isn't in the table yet; overwrite replaces those that are. The table after it.

    Of documents with one source_file that come together one stays, the last by section_id.
    """
    marked = lambda df, new: df.withColumn(ORDER, F.lit(new if overwrite else -new))

    def combine(both: DataFrame) -> DataFrame:
        rows = both.withColumn(ORDER, F.coalesce(ORDER, F.lit(0)))
        return graph.replace_rows(rows, ["source_file"], ORDER, "section_id").drop(ORDER)

    return Table(documents.sparkSession, path).merge(marked(documents, 1), ["source_file"], combine)


class GraphStore:
    """Nodes and edges under a folder, merged by key in buckets. A write that runs again, or late, changes nothing that is newer.

    Readers see nodes and edges as of the last commit, which is one file for both tables.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.node_table, self.edge_table = Table(spark, f"{path}/nodes", buckets), Table(spark, f"{path}/edges", buckets)

    def _commits(self) -> list[int]:
        return sorted(int(c[2:]) for c in children(self.spark, f"{self.path}/commits") if c.startswith("c="))

    def _commit(self, number: int) -> dict[str, int]:
        return json.loads(get_text(self.spark, f"{self.path}/commits/c={number}"))

    def _publish(self) -> None:
        """Show the newest versions of both tables, and delete what neither this commit nor the one before it has."""
        tables = {"nodes": self.node_table, "edges": self.edge_table}
        old = self._commits()
        now = {name: max(t.versions(), default=0) for name, t in tables.items()}
        put_text(self.spark, f"{self.path}/commits/c={1 + max(old, default=0)}", json.dumps(now))
        before = self._commit(old[-1]) if old else now
        for name, t in tables.items():
            t.keep({now[name], before[name]} - {0})
        for c in old[:-1]:
            delete(self.spark, f"{self.path}/commits/c={c}")

    def _shown(self, name: str, table: Table) -> DataFrame | None:
        commits = self._commits()
        version = self._commit(commits[-1])[name] if commits else 0
        rows = table.read(version) if version else None
        return rows.drop(graph.SET_BY, ORDER) if rows is not None else None

    def nodes(self) -> DataFrame | None:
        return self._shown("nodes", self.node_table)

    def edges(self) -> DataFrame | None:
        return self._shown("edges", self.edge_table)

    def _put_nodes(self, writes: DataFrame, sequence: str) -> None:
        self.node_table.merge(graph.stamped(writes, graph.NODE, sequence), graph.NODE, lambda both: graph.merge_stamped(both, graph.NODE), held=None)

    def _known(self, writes: DataFrame) -> DataFrame:
        """Keys of the nodes that the writes' ends may be: of their buckets only."""
        ends = F.explode(F.array(*[
            F.struct(text.lookup({r: x[k] for r, x in fixed.RELATIONS.items()})[F.col("relation_type")].alias("label"), F.col(f"{end}_id").alias("node_id"))
            for k, end in enumerate(("subject", "object"))
        ]))
        wanted = writes.select(ends.alias("e")).select(self.node_table.bucket("e.label", "e.node_id").alias("b")).distinct()
        found = self.node_table.read(buckets=[r["b"] for r in wanted.collect()])
        return found.select(*graph.NODE) if found is not None else self.spark.createDataFrame([], "label string, node_id string")

    def _put_edges(self, writes: DataFrame, *order: str, valid: bool = True) -> None:
        own = graph.valid_edges(writes, self._known(writes)) if valid else writes
        refs = F.when(F.col("filing_ref").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col("filing_ref").cast("string")))
        own = own.withColumn("filing_refs", refs).withColumn(ORDER, F.struct(*order)).drop(*order)

        def combine(both: DataFrame) -> DataFrame:
            every = F.array_sort(F.array_distinct(F.flatten(F.collect_set("filing_refs")))).alias("filing_refs")
            props = [c for c in both.columns if c not in (*graph.EDGE, "filing_refs")]
            last = F.max_by(F.struct(*props), F.struct(ORDER, F.struct(*[c for c in props if c != ORDER])))
            return both.groupBy(*graph.EDGE).agg(last.alias("e"), every).select(*graph.EDGE, "e.*", "filing_refs")

        self.edge_table.merge(own, graph.EDGE, combine, held=None)

    def upsert_nodes(self, writes: DataFrame, sequence: str = "seq") -> DataFrame:
        """Merge writes(node_id, label, properties, sequence): each property has its value of the highest sequence, and nulls never overwrite."""
        self._put_nodes(writes, sequence)
        self._publish()
        return self.nodes()

    def upsert_edges(self, writes: DataFrame, *order: str, valid: bool = True) -> DataFrame:
        """Merge writes whose ends exist under the relation's labels; of a triple the last write in order counts, and all its filings are kept in filing_refs.

        Without nodes no edge is valid. With valid=False ends aren't looked up.
        """
        self._put_edges(writes, *(order or ("seq",)), valid=valid)
        self._publish()
        return self.edges()

    def write_documents(self, nodes: DataFrame, edges: DataFrame, sequence: str = "seq") -> tuple[DataFrame, DataFrame]:
        """Nodes of all documents with the years of the chain, and their edges with the chain: shown by one commit."""
        year, chain = graph.years(self.spark)
        none = F.lit(None).cast(nodes.schema[sequence].dataType)
        self._put_nodes(nodes.unionByName(year.withColumn(sequence, none), allowMissingColumns=True), sequence)
        extra = chain.withColumn("filing_ref", F.lit(None).cast("string"))
        self._put_edges(edges.unionByName(extra, allowMissingColumns=True), sequence)
        self._publish()
        return self.nodes(), self.edges()

    def replace(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Put a cleaned graph in place of the one that is there; sequences stay with the rows that do."""
        def kept(table: Table, rows: DataFrame, keys: list[str], *own: str) -> None:
            old = table.read()
            held = rows if old is None else rows.join(old.select(*keys, *(c for c in own if c in old.columns)), keys, "left")
            table.write(held, held=None)

        kept(self.node_table, nodes, graph.NODE, graph.SET_BY)
        kept(self.edge_table, edges, graph.EDGE, ORDER)
        self._publish()
        return self.nodes(), self.edges()


def write_glossary(found: DataFrame, path: str, *order: str, buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """Merge mentions into the store of earlier ones: facts are kept with the place where each was first met, so a run reads
    new sentences and the buckets of their terms only, and one that is run again changes nothing. The store after it.
    """
    spark = found.sparkSession
    for name, rows in glossary.told(found, *order).items():
        # most sentences give a term once, so sources are put together by the merge alone
        rows = rows if name == "sources" else glossary.combined(name, rows)
        # a term's facts are in one bucket
        Table(spark, f"{path}/{name}", buckets).merge(rows, ["key"], lambda both, name=name: glossary.combined(name, both))
    return read_glossary(spark, path)


def read_glossary(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    held = {name: Table(spark, f"{path}/{name}").read() for name in glossary.FACTS}
    return None if any(df is None for df in held.values()) else glossary.store_of(held)


def append_new(rows: DataFrame, path: str, *keys: str, partitions: tuple[str, ...] = ()) -> int:
    """Append rows whose keys the table doesn't have, once each, and say how many."""
    spark = rows.sparkSession
    own = rows.dropDuplicates(list(keys))
    if exists(spark, path):
        own = own.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    own = own.persist()
    try:
        n = own.count()
        if n:
            writer = own.write.mode("append").option("compression", "zstd")
            (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
        return n
    finally:
        own.unpersist()


def add_vectors(rows: DataFrame, path: str) -> int:
    """Append rows(id, document, embedding, ...) with ids that the store doesn't have."""
    return append_new(rows, path, "id")


def write_events(events: DataFrame, path: str) -> int:
    """Append events that aren't there, in a folder a year."""
    return append_new(events.withColumn("year", F.year("date")), path, "event_id", partitions=("year",))


class Index:
    """The index of companies, filings and deltas: each a table of whole rows by key, of which the last write counts."""

    KEYS = {"companies": "cik", "filings": "accession", "deltas": "id"}

    def __init__(self, spark: SparkSession, path: str):
        self.tables = {name: Table(spark, f"{path}/{name}") for name in self.KEYS}

    def read(self, name: str) -> DataFrame | None:
        rows = self.tables[name].read()
        return rows.drop(ORDER) if rows is not None else None

    def find(self, name: str, key: str) -> DataFrame | None:
        """The row of a key, from its bucket alone."""
        table = self.tables[name]
        one = table.spark.range(1).select(table.bucket(F.lit(key))).first()[0]
        rows = table.read(buckets=[one])
        return rows.drop(ORDER).where(F.col(self.KEYS[name]) == key) if rows is not None else None

    def replace_rows(self, name: str, rows: DataFrame, sequence: str | None = None) -> DataFrame:
        """Put whole rows in place of those with their keys; with a sequence only of those written with a lower or equal one."""
        key, table = self.KEYS[name], self.tables[name]
        at = F.col(sequence).cast("long") if sequence else F.lit(1 + max(table.versions(), default=0)).cast("long")
        rows = rows.withColumn(ORDER, at)
        table.merge(rows.drop(sequence) if sequence else rows, [key], lambda both: graph.replace_rows(both, [key], ORDER))
        return self.read(name)

    def clear(self) -> None:
        for table in self.tables.values():
            table.clear()


def dry_run(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, of and n: how many nodes of each label and edges of each relation a write would have."""
    return nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("of")).agg(F.count("*").alias("n")).unionByName(
        edges.groupBy(F.lit("edge").alias("kind"), F.col("relation_type").alias("of")).agg(F.count("*").alias("n"))
    )


def save_session(turns: DataFrame, path: str) -> DataFrame:
    """The turns of conversations, whole, in place of those saved before."""
    return Table(turns.sparkSession, path).write(turns)


def load_session(spark: SparkSession, path: str) -> DataFrame | None:
    """The turns saved last; None where there are none. A folder that can't be read is an error."""
    return Table(spark, path).read()


def cache_delta(index: Index, payloads: DataFrame) -> DataFrame:
    """Keep payloads by latest|previous as JSON."""
    return index.replace_rows("deltas", payloads.select("id", F.to_json(F.struct(*payloads.columns)).alias("data")))
