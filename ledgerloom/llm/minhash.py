"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations give the whole signature: sigma scatters shingles over a universe of 2**22 places,
pi, shifted circularly by k, gives coordinate k. Bands of equal coordinates propose candidates; the
decision rests on the full shingle sets.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import drop, stage

#: Coordinates of a band.
ROWS = 5
UNIVERSE = 1 << 22
#: Chances at most that a pair of just the similarity asked for shares no band, and agrees in too few coordinates.
MISSED_BANDS, MISSED_EQUAL = 2.5e-7, 2.5e-8
#: Ids sent to all executors at most; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Members of a bucket on either side of what one task compares.
BLOCK = 1024
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache
def banding(percent: int) -> tuple[int, int]:
    """The least number of bands, and of equal coordinates, at which pairs of this similarity aren't missed."""
    s = percent / 100
    if s >= 1:
        return 1, ROWS
    bands = math.ceil(math.log(MISSED_BANDS) / math.log1p(-(s**ROWS)))
    k, below = bands * ROWS, 0.0
    for least in range(k + 1):
        log = math.lgamma(k + 1) - math.lgamma(least + 1) - math.lgamma(k - least + 1) + least * math.log(s) + (k - least) * math.log1p(-s)
        below += math.exp(log)
        if below > MISSED_EQUAL:
            break
    return bands, least


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * P2
    x = (x ^ (x >> np.uint64(32))) * P2
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    Words are runs without ASCII white space, A-Z in lower case. Fewer words than size make one
    shingle; a text without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * P1 + w[k : len(w) - n + 1 + k]
    return np.unique(mix(h))


@functools.lru_cache(maxsize=1)
def circulant(seed: int, k: int) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Rows of pi's circular windows, and the two numbers of sigma."""
    rng = np.random.default_rng(seed)
    pi = rng.permutation(UNIVERSE).astype(np.uint32)
    odd, add = (rng.integers(UNIVERSE, size=2) | 1).astype(np.uint64)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k), odd, add


def signature(shingles: np.ndarray, seed: int, k: int) -> np.ndarray:
    """k coordinates: the least pi at each circular shift of the places of the shingles."""
    windows, odd, add = circulant(seed, k)
    x = shingles >> np.uint64(64 - 22)
    x = (x * odd + add) & np.uint64(UNIVERSE - 1)
    x ^= x >> np.uint64(11)
    out = np.full(k, UNIVERSE, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(out, windows[x[at : at + 4096]].min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, shingle: int, seed: int, bands: int) -> DataFrame:
    """doc_id, set size, digest of the set, band hashes and a byte of each coordinate."""

    k = bands * ROWS

    def rows(ids, texts):
        sets = [shingle_set(t, shingle) for t in texts]
        sigs = np.array([signature(s, seed, k) for s in sets], np.uint32).reshape(-1, k)
        h = np.zeros((len(sets), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
        for r in range(ROWS):
            h = mix(h * P1 + sigs.reshape(-1, bands, ROWS)[:, :, r].astype(np.uint64) + np.uint64(1))
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.FixedSizeListArray.from_arrays(pa.array(h.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64())),
                pa.array([x.tobytes() for x in sigs.astype(np.uint8)], pa.binary()),
            ],
            names=["doc_id", "n", "digest", "bands", "sketch"],
        )

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield rows(part.column(0), (x.as_py() for x in part.column(1)))

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, bands array<long>, sketch binary")


def shared_enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node that each node of the edges (a, b) reaches.

    Labels take the least of their neighbours' and jump to their label's label, each round staged.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("least"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("jumped"))
        new = lower.join(jump, "to", "left").select("node", "old", F.least("to", "jumped").alias("comp"))
        new = stage(new, "labels")
        if new.where("old <> comp").limit(1).isEmpty():
            drop(both, new)
            return labels
        drop(labels)
        labels = new


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, seed: int = 7) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked. Exact
    copies of a set are one node from the start. Each bucket of a band first links its members to
    its smallest one; buckets that still hold several components compare the members of different
    components, in blocks, so that no proposed link between different components is lost.

    Null or empty texts have no shingles and stay alone. A null doc_id takes part in no link: its
    component_id is the smallest doc_id with the same set, or null, and it is not kept. Rows that
    repeat a doc_id are one node.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sigs = stage(signatures(docs, shingle, seed, banding(percent)[0]), "signatures")
    filled = sigs.where("n > 0")
    first = stage(filled.groupBy("digest").agg(F.min("doc_id").alias("node")).where("node is not null"), "classes")
    classes = stage(
        filled.join(first.withColumnRenamed("node", "doc_id"), ["digest", "doc_id"]).select(F.col("doc_id").alias("node"), "n", "bands", "sketch"), "nodes"
    )
    rows = classes.select("node", F.explode("bands").alias("bucket"))
    centers = stage(rows.groupBy("bucket").agg(F.min("node").alias("center"), F.count("*").alias("members")).where("members > 1"), "buckets")
    crowded = stage(rows.join(centers, "bucket"), "crowded")
    tested = crowded.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    size = classes.select("node", "n", "sketch").dropDuplicates(["node", "n"])
    tested = stage(_plausible(tested, size, percent), "stars")
    edges = _verified(docs, tested, percent, shingle)
    comps = components(edges)
    label = crowded.join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = label.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket")
    mixed = stage(mixed, "mixed")
    left = stage(label.join(mixed, "bucket"), "left")
    more = _cross(docs, left, classes, percent, shingle)
    if not more.limit(1).isEmpty():
        before, comps = comps, components(edges.union(more))
        drop(before)
    drop(centers, crowded, tested, edges, mixed, left, more)
    member = filled.join(first, "digest", "left").select("doc_id", "n", "node")
    member = member.join(comps, "node", "left").select("doc_id", "n", F.coalesce("comp", "node").alias("component_id"))
    alone = sigs.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return member.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def _plausible(pairs: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and signatures allow a link."""
    a, b = (size.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    near = pairs.join(a, "a").join(b, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    bands, least = banding(percent)
    width = bands * ROWS

    def run(batches):
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, width) for c in ("s_a", "s_b"))
            ok = (x == y).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    return near.mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node and its shingle set, for the nodes given; a staged table."""
    nodes = stage(nodes.distinct().toDF("doc_id"), "wanted")
    few = nodes.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(nodes) if few else nodes, "doc_id", "left_semi")

    def sets(batches):
        for t in batches:
            for at in range(0, t.num_rows, 1024):
                part = t.slice(at, 1024)
                held = pa.array([shingle_set(x.as_py(), shingle).tobytes() for x in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), held], names=["node", "held"])

    out = stage(texts.mapInArrow(sets, "node long, held binary"), "sets")
    drop(nodes)
    return out


def _cross(docs: DataFrame, members: DataFrame, classes: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links between members of a bucket that are in different components, as a staged table.

    Members of a bucket's largest component need no comparison with one another: they are dealt to
    blocks, once each, and the others, in blocks too, go to each of those and to one another. A
    task compares signatures first and full sets where they agree, leaves a pair that shares an
    earlier band to that one, and skips pairs that its own links have joined, so what it returns is
    linear in its members.
    """
    held = _sets(docs, members.select("node"), shingle)
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("own"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("own", "comp")).alias("top"), F.sum("own").alias("all"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    # a bucket of one block is compared as it is
    small = F.col("all") <= BLOCK
    main, rest = F.when(small, 0).otherwise(blocks(F.col("top.own"))), F.when(small, 1).otherwise(blocks(F.col("all") - F.col("top.own")))
    sizes = sizes.select("bucket", F.when(~small, F.col("top.comp")).alias("top"), main.alias("main"), rest.alias("rest"))
    # sizes join first, while rows are narrow: a bucket's wide rows are then dealt by blocks and never by the bucket alone
    full = members.join(sizes, "bucket").join(classes.select("node", "n", "bands", "sketch").dropDuplicates(["node", "n"]), "node").join(held, "node")
    full = full.where(F.octet_length("held") == 8 * F.col("n"))
    # sides are numbered: blocks of the rest from 0, those of the largest component after them
    inside = F.coalesce(F.col("comp") == F.col("top"), F.lit(False))
    own = F.pmod(F.xxhash64("node"), F.when(inside, F.col("main")).otherwise(F.col("rest"))).cast("int") + F.when(inside, F.col("rest")).otherwise(0)
    last = F.col("rest") + F.when(inside, 0).otherwise(F.col("main")) - 1
    dealt = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "n", "bands", "sketch", "held")

    n_bands, least = banding(percent)
    width = n_bands * ROWS

    def run(key, t):
        i, j = key[1].as_py(), key[2].as_py()
        own, node, comp, n = (t.column(c).to_numpy().copy() for c in ("own", "node", "comp", "n"))
        s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, width)
        bands = np.array(t.column("bands").to_pylist(), np.int64).reshape(-1, n_bands)
        band = int((bands[0] == key[0].as_py()).argmax())
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("held")]
        right = np.flatnonzero(own == j)
        found = []
        for x in np.flatnonzero(own == i):
            y = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            y = y[~(bands[y, :band] == bands[x, :band]).any(axis=1)]
            same = (s[y] == s[x]).sum(axis=1)
            for k in y[np.argsort(-same, kind="stable")][: int((same >= least).sum())]:
                if comp[k] != comp[x] and shared_enough(sets[x], sets[k], percent):
                    found.append((node[x], node[k]))
                    comp[comp == comp[k]] = comp[x]
        return pa.table({c: pa.array([int(p[k]) for p in found], pa.int64()) for k, c in enumerate("ab")})

    out = stage(dealt.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct(), "links")
    drop(held)
    return out


def _verified(docs: DataFrame, pairs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough, as a staged table."""
    held = _sets(docs, pairs.select("a").union(pairs.select("b")), shingle)
    a, b = (held.select(F.col("node").alias(c), F.col("held").alias(f"h_{c}")) for c in "ab")

    def run(batches):
        for t in batches:
            x, y = (t.column(c) for c in ("h_a", "h_b"))
            ok = [shared_enough(*(np.frombuffer(v.as_buffer(), np.uint64) for v in xy), percent) for xy in zip(x, y)]
            yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    out = stage(pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long").distinct(), "links")
    drop(held)
    return out


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
