"""Approximate cosine search: inverted lists by k-means, product-quantised codes, exact scores for what is left.

An index is a table of versions with a folder a list. A query reads the codes of its nearest lists
only, and the vectors of its best candidates only. Lists and codebooks are learnt from a bounded
sample; every row is indexed.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.vectors import unit
from ledgerloom.shared import Table, stage

#: Rows that lists and codebooks are learnt from at most, and lists at most.
SAMPLE, MOST_LISTS = 50_000, 4_096
#: Codes of a part of a vector, and dimensions of a part at least.
CODES, PART = 256, 4
#: Rows of a group of lists, and queries, that one task compares.
ROWS, QUERIES = 50_000, 2_000
#: Lists that a query reads, as a share of all, and candidates with exact scores, as a multiple of k.
SHARE, EXACT = 0.25, 8


def means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k centres of the rows of x by Lloyd's rounds, from starts far from one another; a centre without rows takes the row worst served."""
    k = min(k, len(x))
    norm = (x * x).sum(axis=1)
    centres = np.empty((k, x.shape[1]))
    near = np.full(len(x), np.inf)
    for j in range(k):
        p = np.maximum(near, 0)
        at = int(rng.integers(len(x))) if j == 0 or p.sum() == 0 else int(rng.choice(len(x), p=p / p.sum()))
        centres[j] = x[at]
        near = np.minimum(near, norm - 2 * x @ centres[j] + norm[at])
    for _ in range(rounds):
        of = nearest(x, centres)
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
        if not full.all():
            far = np.argsort(-((x - centres[of]) ** 2).sum(axis=1), kind="stable")
            centres[~full] = x[far[: int((~full).sum())]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[at : at + 4096] @ centres.T - half, axis=1) for at in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def grouped(sizes: list[int]) -> tuple[list[int], list[int]]:
    """Lists that follow one another, put together to groups of ROWS rows at most: each group's end, and blocks that its rows are dealt to (1 but for a list of more)."""
    ends, rows = [], []
    for at, n in enumerate(sizes, 1):
        if ends and rows[-1] + n <= ROWS:
            ends[-1], rows[-1] = at, rows[-1] + n
        else:
            ends.append(at)
            rows.append(n)
    return ends, [max(1, -(-n // ROWS)) for n in rows]


@dataclasses.dataclass
class Model:
    """Centres of the lists; for each part of a vector its dimensions and the centres of what the lists leave over."""

    centres: np.ndarray
    parts: list[tuple[int, int]]
    books: list[np.ndarray]

    @classmethod
    def learn(cls, sample: np.ndarray, lists: int, seed: int) -> Model:
        rng, width = np.random.default_rng(seed), sample.shape[1]
        centres = means(sample, lists, rng)
        rest = sample - centres[nearest(sample, centres)]
        edges = [*range(0, max(width - PART, 0) + 1, PART), width] if width > PART else [0, width]
        edges = sorted(set(edges))
        parts = list(zip(edges, edges[1:]))
        return cls(centres, parts, [means(rest[:, a:b], CODES, rng) for a, b in parts])

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of unit vectors."""
        of = nearest(x, self.centres)
        rest = x - self.centres[of]
        return of, np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self.parts, self.books)], axis=1).astype(np.uint8)

    def scores(self, queries: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosine of each query and each coded row of a list: a sum of table entries by part."""
        out = np.broadcast_to((queries @ self.centres[of])[:, None], (len(queries), len(codes))).copy()
        for j, ((a, b), book) in enumerate(zip(self.parts, self.books)):
            out += (queries[:, a:b] @ book.T)[:, codes[:, j]]
        return out

    def rows(self) -> list[tuple]:
        return [("centres", 0, 0, self.centres.shape[1], self.centres.ravel().tolist())] + [
            ("book", a, b, b - a, book.ravel().tolist()) for (a, b), book in zip(self.parts, self.books)
        ]

    @classmethod
    def of_rows(cls, rows) -> Model:
        held = {(r["kind"], r["a"], r["b"]): np.array(r["held"]).reshape(-1, r["width"]) for r in rows}
        books = sorted((a, b) for kind, a, b in held if kind == "book")
        return cls(held["centres", 0, 0], books, [held["book", a, b] for a, b in books])


MODEL = "kind string, a int, b int, width int, held array<double>"


class Index:
    """An approximate index of vectors under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.model_table, self.table = Table(spark, f"{path}/model"), Table(spark, f"{path}/rows")

    def model(self) -> Model | None:
        held = self.model_table.read()
        return Model.of_rows(held.collect()) if held is not None else None

    def build(self, base: DataFrame, key: str, vector: str, lists: int | None = None, seed: int = 7) -> Index:
        """Learn from a sample of the rows with the smallest hashes and index all of them, in place of what is there.

        Vectors that are null, of another width than most, or without length aren't indexed. Of rows
        with one key one stays. Without any vector the index is empty.
        """
        rows = base.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
        width = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
        self.model_table.clear()
        self.table.clear()
        if width is None or not width["width"]:
            return self
        rows = rows.where(F.size("v") == width["width"]).dropDuplicates(["id"])
        sample = pa.Table.from_batches(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().to_batches())
        known = unit(sample.column(0).combine_chunks(), width["width"])
        known = known[np.isfinite(known).all(axis=1)]
        if len(known):
            model = Model.learn(known, lists or min(MOST_LISTS, max(1, round(2 * width["n"] ** 0.5))), seed)
            self.model_table.write(self.spark.createDataFrame(model.rows(), MODEL))
            self.table.write(self._coded(rows, model), "list")
        return self

    def _coded(self, rows: DataFrame, model: Model) -> DataFrame:
        shared, width = self.spark.sparkContext.broadcast(model), model.centres.shape[1]

        def run(batches):
            for b in batches:
                x = unit(b.column(1), width)
                ok = np.isfinite(x).all(axis=1)
                of, codes = shared.value.code(x[ok])
                v = pa.FixedSizeListArray.from_arrays(pa.array(x[ok].ravel().astype(np.float32)), width).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).filter(pa.array(ok)), pa.array(of.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), v], names=["id", "list", "codes", "v"]
                )

        return rows.mapInArrow(run, "id long, list int, codes binary, v array<float>")

    def search(self, queries: DataFrame, key: str, vector: str, k: int, share: float = SHARE, exact: int = EXACT) -> DataFrame:
        """query, id, score and rank of about the k nearest rows of each query, ties by id.

        A query reads share of the lists, the nearest ones, and gets exact scores for its exact * k
        best rows there. Lists are put together to groups of ROWS rows, and a list of more is dealt to
        blocks, so a list that holds much of the table is no one task's; a group keeps exact * k rows
        a query, however many lists it has. Queries without a usable vector find nothing.
        """
        model, out = self.model(), f"query long, {'id'} long, score double, rank int"
        if model is None:
            return self.spark.createDataFrame([], out)
        shared, width, n_lists = self.spark.sparkContext.broadcast(model), model.centres.shape[1], len(model.centres)
        probes = max(1, min(n_lists, int(np.ceil(share * n_lists))))

        base = self.table.read()
        # a row a list, of which there are MOST_LISTS at most
        sizes = {r["list"]: r["count"] for r in base.groupBy("list").count().collect()}
        ends, blocks = grouped([sizes.get(i, 0) for i in range(n_lists)])

        def probed(batches):
            for b in batches:
                x = unit(b.column(1), width)
                ok = np.flatnonzero(np.isfinite(x).all(axis=1))
                m = shared.value
                of = np.argsort((m.centres**2).sum(axis=1) / 2 - x[ok] @ m.centres.T, axis=1, kind="stable")[:, :probes]
                asked = np.zeros((len(ok), n_lists), bool)
                np.put_along_axis(asked, of, True, axis=1)
                for g, (start, end) in enumerate(zip([0, *ends], ends)):
                    own = np.flatnonzero(asked[:, start:end].any(axis=1))
                    bits = pa.array([r.tobytes() for r in np.packbits(asked[own, start:end], axis=1)], pa.binary())
                    rows = pa.array(ok[own])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(np.full(len(own), g, np.int32)), bits], names=["query", "q", "g", "lists"])

        wanted = queries.select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("q")).where("query IS NOT NULL AND q IS NOT NULL")
        wanted = stage(wanted.dropDuplicates(["query"]), "queries")
        n_blocks = -(-max(wanted.count(), 1) // QUERIES)
        group_of = F.array(*(F.lit(int(g)) for g in np.searchsorted(ends, np.arange(n_lists), side="right")))
        deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
        n_rows = lambda: F.get(F.array(*(F.lit(n) for n in blocks)), F.col("g"))
        left = base.select("id", "list", "codes", F.get(group_of, F.col("list")).alias("g")).withColumn("i", deal("id", n_rows())).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        right = wanted.mapInArrow(probed, "query long, q array<double>, g int, lists binary")
        right = right.withColumn("j", deal("query", F.lit(n_blocks))).withColumn("i", F.explode(F.sequence(F.lit(0), n_rows() - 1)))
        most = exact * k

        def best(of, rows: pa.Table, asked: pa.Table) -> pa.Table:
            found = []
            if rows.num_rows and asked.num_rows:
                start = ([0, *ends])[of[0].as_py()]
                rows = rows.sort_by("list")
                codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
                ids, lists, x = rows.column("id").to_numpy(), rows.column("list").to_numpy(), unit(asked.column("q").combine_chunks(), width)
                bits = np.unpackbits(np.array([np.frombuffer(v, np.uint8) for v in asked.column("lists").to_pylist()]), axis=1).astype(bool)
                held, at_row = np.unique(lists, return_index=True)
                for at in range(0, len(x), 64):
                    s = np.full((len(x[at : at + 64]), len(ids)), -np.inf)
                    for one, a, b in zip(held, at_row, [*at_row[1:], len(ids)]):
                        q = np.flatnonzero(bits[at : at + 64, one - start])
                        s[q, a:b] = shared.value.scores(x[at + q], one, codes[a:b])
                    top = np.argpartition(-s, min(most, s.shape[1]) - 1, axis=1)[:, :most]
                    near, q = np.take_along_axis(s, top, 1), np.repeat(asked.column("query").to_numpy()[at : at + 64], top.shape[1])
                    read = np.isfinite(near.ravel())
                    found.append((q[read], ids[top].ravel()[read], lists[top].ravel()[read], near.ravel()[read]))
            q, i, of, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))
            return pa.table({"query": q, "id": i, "list": of, "near": s})

        some = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInArrow(best, "query long, id long, list int, near double")
        place = lambda *by: F.row_number().over(Window.partitionBy("query").orderBy(*by))
        some = some.withColumn("place", place(F.desc("near"), "id")).where(F.col("place") <= most).select("query", "id", "list")
        whole = some.join(base.select("id", "list", "v"), ["list", "id"]).join(wanted, "query")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        v = F.col("v").cast("array<double>")
        scored = whole.select("query", "id", (dot("q", v) / F.sqrt(dot("q", "q") * dot(v, v))).alias("s"))
        return scored.withColumn("rank", place(F.desc("s"), "id")).where(F.col("rank") <= k).select("query", "id", F.round("s", 3).alias("score"), "rank")
