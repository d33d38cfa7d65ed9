"""Property-graph operators over node and edge DataFrames.

Nodes have node_id and label, edges subject_id, relation_type and object_id; both carry further columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions import text
from ledgerloom.operators import paths
from ledgerloom.shared import TASK_ROWS, scratch, spread, stage

#: Nodes sent to all executors at most; beyond it the join shuffles.
BROADCAST_NODES = 100_000
EDGE = ["subject_id", "relation_type", "object_id"]
ENDS = ["subject_id", "object_id"]


def ordered(key: str, *order: Column | str) -> Window:
    return Window.partitionBy(key).orderBy(*order)


# merges


NODE = ["label", "node_id"]


def merge_nodes(writes: DataFrame, key: str | list[str], sequence: str) -> DataFrame:
    """One node a key: of each property the last value that isn't null, so a null never overwrites."""
    keys = [key] if isinstance(key, str) else key
    props = [c for c in writes.columns if c not in (*keys, sequence)]
    return writes.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(sequence))).alias(c) for c in props])


#: The sequence of the write that set each property, kept with the row.
SET_BY = "_set_by"


def stamped(writes: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Writes with the sequence at each property that they set, in place of their own."""
    props = [c for c in writes.columns if c not in (*keys, sequence)]
    return writes.select(*keys, *props, F.struct(*[F.when(F.col(c).isNotNull(), F.col(sequence)).alias(c) for c in props]).alias(SET_BY))


def merge_stamped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: each property's value of the highest sequence, a null never counting, with that sequence.

    A row made so is the same however often, and in whatever order, its writes are merged.
    """
    props = [c for c in rows.columns if c not in (*keys, SET_BY)]
    # a set property without a sequence comes before all with one, and after those not set
    by = {c: F.struct(F.col(c).isNotNull(), F.col(f"{SET_BY}.{c}")) for c in props}
    values = [F.max_by(c, by[c]).alias(c) for c in props]
    merged = rows.groupBy(*keys).agg(*values, F.struct(*[F.max(f"{SET_BY}.{c}").alias(c) for c in props]).alias(SET_BY))
    return merged.select(*keys, *props, SET_BY)


def merge_edges(writes: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One edge a key triple: the properties of its last write."""
    props = [c for c in writes.columns if c not in keys]
    last = F.max_by(F.struct(*props), F.struct(*order))
    return writes.groupBy(*keys).agg(last.alias("e")).select(*keys, "e.*")


def replace_rows(writes: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key: the whole of its last write, nulls included."""
    return merge_edges(writes, keys, *order)


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, whose use fails if two rows share the keys."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"repeated {keys}"))).otherwise(F.col("_n"))).where("_n = 1").drop("_n")


def valid_edges(edges: DataFrame, nodes: DataFrame, schema: dict[str, tuple[str, str]] = fixed.RELATIONS) -> DataFrame:
    """Edges whose ends exist under the labels that the relation asks for."""
    labels = edges.withColumns({
        "subject_label": text.lookup({r: a for r, (a, _) in schema.items()})[F.col("relation_type")],
        "object_label": text.lookup({r: b for r, (_, b) in schema.items()})[F.col("relation_type")],
    })
    for end in ("subject", "object"):
        known = nodes.select(F.col("node_id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"))
        labels = labels.join(known, [f"{end}_id", f"{end}_label"], "left_semi")
    return labels.select(edges.columns)


def years(spark: SparkSession, first: int = fixed.FIRST_YEAR, last: int = fixed.LAST_YEAR) -> tuple[DataFrame, DataFrame]:
    """FiscalYear nodes and the PRECEDES chain over them."""
    year = spark.range(first, last + 1).select(F.col("id").alias("year"), F.format_string("fy_%d", "id").alias("node_id"), F.lit("FiscalYear").alias("label"))
    chain = year.where(F.col("year") < last).select(
        F.col("node_id").alias("subject_id"), F.lit("PRECEDES").alias("relation_type"), F.format_string("fy_%d", F.col("year") + 1).alias("object_id")
    )
    return year, chain


def filed_in(filings: DataFrame, first: int = fixed.FIRST_YEAR, last: int = fixed.LAST_YEAR) -> DataFrame:
    """FILED_IN edges of filings(accession, fiscal_year) whose year is in the chain."""
    inside = filings.where(F.col("fiscal_year").between(first, last))
    return inside.select(F.col("accession").cast("string").alias("subject_id"), F.lit("FILED_IN").alias("relation_type"), F.format_string("fy_%d", "fiscal_year").alias("object_id"))


# deletions and merges of nodes by rule


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes in gone(node_id)."""
    left = edges
    for end in ("subject_id", "object_id"):
        left = left.join(gone.select(F.col("node_id").alias(end)), end, "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), left.select(edges.columns)


def degrees(nodes: DataFrame, edges: DataFrame, label: str, relation: str) -> DataFrame:
    """node_id and the number of distinct subjects of each node of a label, 0 for those without."""
    of = edges.where(F.col("relation_type") == relation).select("object_id", "subject_id").distinct().groupBy("object_id").agg(F.count("*").alias("degree"))
    own = nodes.where(F.col("label") == label).select("node_id")
    return own.join(of, F.col("node_id") == F.col("object_id"), "left").select("node_id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def prune_singletons(nodes: DataFrame, edges: DataFrame, label: str = "Competitor", relation: str = "COMPETES_WITH") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of a label that one subject at most points to."""
    return detach_delete(nodes, edges, degrees(nodes, edges, label, relation).where("degree <= 1").select("node_id"))


def merge_aliases(nodes: DataFrame, edges: DataFrame, aliases: dict[str, str], label: str) -> tuple[DataFrame, DataFrame]:
    """Edges of nodes that are named by an alias moved to the node of its canonical name, once each, and the aliases deleted.

    nodes has a name. An alias whose canonical node doesn't exist stays. Of nodes with one name the
    least node_id is the canonical one.
    """
    own = nodes.where(F.col("label") == label).select("node_id", "name")
    canon = own.groupBy("name").agg(F.min("node_id").alias("canonical"))
    gone = own.withColumn("name", text.lookup(aliases)[F.col("name")]).where("name IS NOT NULL").join(canon, "name")
    gone = gone.where("node_id <> canonical").select("node_id", "canonical")
    moved = edges
    for end in ("subject_id", "object_id"):
        to = gone.select(F.col("node_id").alias(end), F.col("canonical").alias("_to"))
        moved = moved.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    rest = [c for c in edges.columns if c not in EDGE]
    once = moved.groupBy(*EDGE).agg(F.min(F.struct(*rest)).alias("e")).select(*EDGE, "e.*") if rest else moved.select(EDGE).distinct()
    return nodes.join(gone, "node_id", "left_anti"), once.select(edges.columns)


# neighbourhoods


def ego(edges: DataFrame, node: str, hops: int = 1) -> DataFrame:
    """Edges within hops of a node: those that touch a node which lies less than that away.

    A round a hop joins all edges to the nodes that the last one has met; only what touches these is made distinct.
    """
    own = stage(edges, "edges")
    near = last = own.sparkSession.range(1).select(F.lit(node).cast("string").alias("node_id"))
    for _ in range(hops - 1):
        met = [own.join(last.withColumnRenamed("node_id", a), a, "left_semi").select(F.col(b).alias("node_id")) for a, b in (ENDS, ENDS[::-1])]
        last = stage(met[0].union(met[1]).where("node_id IS NOT NULL").distinct().join(near, "node_id", "left_anti"), "near")
        if not (n := last.count()):
            break
        near, last = near.union(last), F.broadcast(last) if n <= BROADCAST_NODES else last
    near = F.broadcast(near) if near.count() <= BROADCAST_NODES else near
    parts = [own.join(near.withColumnRenamed("node_id", c), c, "left_semi").select(own.columns) for c in ENDS]
    return spread(parts[0].union(parts[1]), own.count(), *EDGE).distinct()


def neighbours(edges: DataFrame, node: str | Column, relation: str, most: int = 20) -> DataFrame:
    """Objects of a node's edges of one relation with their number, most frequent first."""
    of = edges.where((F.col("subject_id") == node) & (F.col("relation_type") == relation))
    return of.groupBy("object_id").agg(F.count("*").alias("edges")).orderBy(F.col("edges").desc(), "object_id").limit(most)


def pointing_at(edges: DataFrame, node: str, relation: str, most: int = 50) -> DataFrame:
    """Subjects whose edges of one relation end at a node, in order."""
    of = edges.where((F.col("object_id") == node) & (F.col("relation_type") == relation))
    return of.select("subject_id").distinct().orderBy("subject_id").limit(most)


def chain(edges: DataFrame, *relations: str, optional: bool = False) -> DataFrame:
    """Paths along relations: n0, n1, ...; a relation written <R is followed backwards. Optional ones keep shorter paths."""
    out = None
    for k, r in enumerate(relations):
        back = r.startswith("<")
        step = edges.where(F.col("relation_type") == r.lstrip("<"))
        a, b = ("object_id", "subject_id") if back else ("subject_id", "object_id")
        step = step.select(F.col(a).alias(f"n{k}"), F.col(b).alias(f"n{k + 1}")).distinct()
        out = step if out is None else out.join(step, f"n{k}", "left" if optional else "inner")
    return out.select(*[f"n{k}" for k in range(len(relations) + 1)])


def branches(edges: DataFrame, base: DataFrame, key: str, **relations: str) -> DataFrame:
    """base with a sorted array of distinct objects for each relation, each gathered by itself before the join, so branches don't multiply."""
    for name, r in relations.items():
        of = edges.where(F.col("relation_type") == r).groupBy(F.col("subject_id").alias(key)).agg(F.array_sort(F.collect_set("object_id")).alias(name))
        base = base.join(of, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return base


def cooccurring(members: DataFrame, group: str, item: str) -> DataFrame:
    """a, b and the number of groups with both, for items a < b of members; a group's items are distinct first."""
    d = members.select(F.col(group).alias("g"), F.col(item).alias("a")).distinct()
    return d.join(d.withColumnRenamed("a", "b"), "g").where("a < b").groupBy("a", "b").agg(F.count("*").alias("groups"))


def across_years(items: DataFrame, owner: str, item: str, year: str) -> DataFrame:
    """owner, item, year and link: EMERGED_IN its first year of a run, PERSISTED_TO the next, RESOLVED_IN the year after the last.

    An item is resolved only where the owner has a later year at all.
    """
    d = items.select(F.col(owner).alias("owner"), F.col(item).alias("item"), F.col(year).cast("long").alias("year")).distinct()
    before = d.select("owner", "item", (F.col("year") + 1).alias("year"), F.lit(True).alias("was"))
    last = d.groupBy("owner").agg(F.max("year").alias("last"))
    both = d.withColumn("now", F.lit(True)).join(before, ["owner", "item", "year"], "full").join(last, "owner")
    link = F.when(F.col("now") & F.col("was"), "PERSISTED_TO").when(F.col("now"), "EMERGED_IN").otherwise("RESOLVED_IN")
    return both.where("now OR year <= last").select("owner", "item", "year", link.alias("link"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of edges(src, dst) reaches.

    Labels take their neighbours' least and then their label's label; each round is written to the
    shared folder, and what is two rounds old is deleted.
    """
    cut = scratch(edges.sparkSession, "components")
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct().toDF("a", "b"), keep=True)
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")).toDF("node", "component"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("least"))
        new = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "least").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("jumped"))
        new = cut(new.join(jump, "to", "left").select("node", "old", F.least("to", "jumped").alias("component")))
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels


# pictures


def panel(nodes: DataFrame) -> DataFrame:
    """node_id, label and caption of each node as a graph panel shows it."""
    short = lambda c, n: F.substring(F.col(c), 1, n)
    has = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    rows = nodes.withColumns({c: has(c) for c in ("name", "ticker", "year", "accession_number", "section_type", "description") if c not in nodes.columns})
    risk = F.when(F.length("description") > 22, F.concat(short("description", 22), F.lit("…"))).otherwise(F.coalesce(F.nullif("description", F.lit("")), F.lit("Risk")))
    caption = (
        F.when(F.col("label") == "Company", F.substring(F.coalesce("name", "ticker", F.lit("?")), 1, 25))
        .when(F.col("label") == "FiscalYear", F.concat(F.lit("FY"), F.coalesce(F.col("year").cast("string"), F.lit("?"))))
        .when(F.col("label") == "Filing", F.coalesce(F.right("accession_number", F.lit(10)), F.lit("?")))
        .when(F.col("label").isin("GeographicMarket", "Competitor"), F.coalesce(short("name", 20), F.lit("?")))
        .when(F.col("label") == "Section", F.coalesce("section_type", F.lit("Section")))
        .when(F.col("label") == "RiskFactor", risk)
        .when(F.col("label") == "FinancialMetric", F.coalesce(short("name", 20), F.lit("Metric")))
        .when(F.col("label") == "ManagementOutlook", "Outlook")
        .otherwise(F.col("label"))
    )
    props = F.to_json(F.struct(*[c for c in nodes.columns if c not in ("node_id", "label")]))
    return rows.select("node_id", "label", caption.alias("caption"), props.alias("tooltip"))


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a flow chart, in order: its head, a line a node and a line an edge."""
    safe = lambda c: F.regexp_replace(F.col(c), "[^A-Za-z0-9_]", "_")
    parts = [
        nodes.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("graph LR").alias("line")),
        panel(nodes).select(F.lit(1).alias("part"), F.concat(F.lit("  "), safe("node_id"), F.lit('["'), F.replace("caption", F.lit('"'), F.lit("'")), F.lit('"]')).alias("line")),
        edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), safe("subject_id"), F.lit(" -->|"), "relation_type", F.lit("| "), safe("object_id")).alias("line")),
    ]
    return reduce(DataFrame.union, parts).orderBy("part", "line").select("line")


#: Subjects of a group at least and at most (powers of two, of 64 or more); between them there are GROUPS groups or up to twice as many.
LEAST, GROUP, GROUPS = 1 << 10, 1 << 18, 8
#: Tasks over pairs of groups at most, and marks (bytes) that a task holds at once.
PAIR_TASKS, MARKS = 4096, 1 << 21


def sharing(edges: DataFrame) -> DataFrame:
    """subject and sharing: with how many later subjects each of edges(subject, object) has an object in common; those with none are left out.

    Subjects are numbered in order and dealt to groups. An object's subjects in a group are one row,
    which goes to the pairs of groups that the object joins; pairs of subjects are marks inside a task only.
    """
    spark = edges.sparkSession
    cut = scratch(spark, "sharing")
    e = cut(edges.select("subject", "object").where("subject IS NOT NULL AND object IS NOT NULL"), keep=True)
    nth = cut(e.select("subject").distinct().orderBy("subject").select("subject", F.monotonically_increasing_id().alias("nth")), keep=True)
    width = LEAST
    while width < GROUP and 2 * width * GROUPS <= nth.count():
        width *= 2
    group = F.floor(F.col("nth") / width).cast("long")
    dealt = -(-e.count() // TASK_ROWS)
    dealt = e.join(nth, "subject").select("nth", F.xxhash64("object").alias("h")).repartition(max(dealt, int(spark.conf.get("spark.sql.shuffle.partitions"))), group, "h")
    sets = cut(dealt.mapInArrow(lambda batches: _sets(batches, width), "g long, h long, c array<int>"), keep=True)
    n = nth.select(group).distinct().count()
    both = sets.join(sets.select("h", F.col("g").alias("other")), "h")
    # a task for each pair of groups
    tasks = min(max(n * (n + 1) // 2, 1), PAIR_TASKS)
    first = both.where("g <= other").select(F.col("g").alias("a"), F.col("other").alias("b"), "h", "c").repartition(tasks, "a", "b")
    second = both.where("other <= g").select(F.col("other").alias("a"), F.col("g").alias("b"), F.col("h").alias("other_h"), F.col("c").alias("other_c")).repartition(tasks, "a", "b")

    def run(left, right):
        a, b = left.column("a")[0].as_py(), left.column("b")[0].as_py()
        subjects, found = _met(_lists(left, "h", "c"), _lists(right, "other_h", "other_c"), width, a == b)
        return pa.table({"nth": a * width + subjects.astype(np.int64), "n": found})

    counts = first.groupBy("a", "b").cogroup(second.groupBy("a", "b")).applyInArrow(run, "nth long, n long")
    return counts.groupBy("nth").agg(F.sum("n").alias("sharing")).where("sharing > 0").join(nth, "nth").select("subject", "sharing")


def _sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """g, h and c of a task's rows of nth and h: the different places of each object's subjects in each group."""
    held, size = [], 0

    def different():
        x = np.concatenate(held)
        x = x[np.lexsort((x[:, 0], x[:, 1], x[:, 0] // width))]
        return x[np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])]

    for b in batches:
        held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1))
        size += b.num_rows
        if size > 4 * TASK_ROWS:
            held = [different()]
            size = len(held[0])
    if not size:
        return
    x = different()
    g, c, h = x[:, 0] // width, (x[:, 0] % width).astype(np.int32), x[:, 1]
    starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])]))
    ends = np.append(starts, len(x))
    for k in range(0, len(starts), 1024):
        at = starts[k : k + 1024]
        own = ends[k : k + len(at) + 1]
        lists = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(c[own[0] : own[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(g[at]), pa.array(h[at]), lists], names=["g", "h", "c"])


def _lists(table: pa.Table, key: str, values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, with the length of each one's list and all lists' values."""
    table = table.sort_by(key)
    lists = table.column(values).combine_chunks()
    return table.column(key).to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()


def _met(left: tuple, right: tuple, width: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The left subjects and how many of the right ones (of the later ones, if both are the same group) each shares an object with.

    Both sides have the same objects. A row of marks is put together for each subject: an object of few
    right subjects marks them one by one, one of many has them as bits.
    """
    _, left_n, c = left
    _, n, others = right
    starts = np.cumsum(n) - n
    order = np.argsort(c.astype(np.uint16) if width <= 1 << 16 else c, kind="stable")
    c, of = c[order], np.repeat(np.arange(len(left_n), dtype=np.int32), left_n)[order]
    del order
    many = n >= max(width // 128, 2)
    bits = np.zeros((int(many.sum()), width // 8), np.uint8)
    place = np.cumsum(many) - 1
    for k in np.flatnonzero(many):
        row = np.zeros(width, bool)
        row[others[starts[k] : starts[k] + n[k]]] = True
        bits[place[k]] = np.packbits(row)
    bits = bits.view(np.uint64)
    firsts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    subjects, ends = c[firsts], np.append(firsts, len(c))
    found, held = np.zeros(len(subjects), np.int64), max(MARKS // width, 1)
    dense = many[of]
    # marks that the left edges before each one make
    before = np.concatenate([[0], np.cumsum(np.where(dense, 0, n[of]))])
    marks = np.zeros((held, width), bool)
    for k in range(0, len(subjects), held):
        own = subjects[k : k + held]
        low, high = ends[k], ends[k + len(own)]
        some = before[high] > before[low]
        if some:
            marks[:] = False
            row = np.repeat(np.arange(len(own)), np.diff(ends[k : k + len(own) + 1]))
            at = low
            while at < high:
                to = min(max(int(np.searchsorted(before, before[at] + MARKS // 8, "right")) - 1, at + 1), high)
                z = at + np.flatnonzero(~dense[at:to])
                size = n[of[z]]
                ahead = np.cumsum(size) - size
                near = others[np.repeat(starts[of[z]] - ahead, size) + np.arange(size.sum())]
                marks.reshape(-1)[np.repeat(row[z - low] * width, size) + near] = True
                at = to
        if not dense[low:high].any():
            if same:
                for j, s in enumerate(own):
                    marks[j, : s + 1] = False
            found[k : k + len(own)] = np.bitwise_count(marks[: len(own)].view(np.uint64)).sum(axis=1, dtype=np.int64)
            continue
        near = np.packbits(marks[: len(own)], axis=1).view(np.uint64) if some else np.zeros((len(own), width // 64), np.uint64)
        for j in range(len(own)):
            z = slice(ends[k + j], ends[k + j + 1])
            wanted = place[of[z][dense[z]]]
            for q in range(0, len(wanted), 64):
                near[j] |= np.bitwise_or.reduce(bits[wanted[q : q + 64]], axis=0)
        if same:
            flat = near.view(np.uint8)
            for j, s in enumerate(own + 1):
                flat[j, : s >> 3] = 0
                if s < width:
                    flat[j, s >> 3] &= 0xFF >> (s & 7)
        found[k : k + len(own)] = np.bitwise_count(near).sum(axis=1, dtype=np.int64)
    return subjects, found
