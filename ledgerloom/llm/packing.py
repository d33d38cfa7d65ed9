"""Best-fit packing of tokenised documents into sequences by exact-complement hashing."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stage
from ledgerloom.llm.tokens import encoder, ranges

PIECES = "doc_id long, piece int, start long, length int, ids binary, chunk int, nth long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Cut each document's ids and an end id into pieces of at most capacity ids, as a staged table.

    The first piece takes the remainder, so all others are full. A null or empty text has the end
    id alone; a null doc_id is kept; repeated rows are documents of their own. chunk and nth number
    the pieces of one length within a written part, for place().
    """

    def run(batches):
        enc, chunk, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            at = 0
            for n, ids, begin in enc.encode_array(batch.column(1)):
                yield cut(batch.column(0).slice(at, n), ids, begin, chunk, seen)
                at += n

    def cut(doc_ids, ids, begin, chunk, seen):
        """The pieces of the documents whose ids lie end to end in ids."""
        total = np.diff(begin) + 1
        data = np.insert(ids, begin[1:], end_id).astype("<u4")
        first = np.where(total % capacity, total % capacity, capacity)
        n = (total - first) // capacity + 1
        doc, piece = np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)
        length = np.where(piece == 0, first[doc], capacity)
        start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
        # number within the pieces of one length
        order = np.argsort(length, kind="stable")
        nth, sizes = np.empty(len(order), np.int64), np.bincount(length, minlength=capacity + 1)
        nth[order] = ranges(seen, sizes)
        seen += sizes
        ends = np.append(0, np.cumsum(length * 4)).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays(
            [
                doc_ids.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)),
                held, pa.array(np.full(len(doc), chunk, np.int32)), pa.array(nth),
            ],
            names=["doc_id", "piece", "start", "length", "ids", "chunk", "nth"],
        )

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)
    return stage(found, "pieces")


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """The plan with the fewest sequences of those that consume exact threes, pairs or single lengths at most."""
    return min((_plan(counts, capacity, most) for most in (3, 2, 1)), key=lambda p: p[1])


def _plan(counts: dict[int, int], capacity: int, most: int) -> tuple[np.ndarray, int]:
    """Segments (length, first rank, per sequence, first sequence, offset) and the number of sequences.

    Lengths that fill a sequence alone, in pairs and in threes are looked up by their complement
    and consumed as often as the counts allow; best-fit decreasing places what is left. All steps
    run on counts, so the work depends on the capacity and not on the number of documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(capacity + 1, np.int64)
    segments: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def take(length: int, n: int, each: int, base: int, offset: int) -> None:
        """n pieces of a length, each to a sequence, from sequence base."""
        segments.append((length, int(used[length]), each, base, offset))
        used[length] += n
        left[length] -= n

    def fill(lengths: tuple[int, ...], n: int) -> None:
        nonlocal sequences
        offset = 0
        for length in lengths:
            take(length, n, 1, sequences, offset)
            offset += length
        sequences += n

    if left[capacity]:
        fill((capacity,), int(left[capacity]))
    for a in range(capacity - 1, capacity // 2 if most > 1 else capacity, -1):
        if n := int(min(left[a], left[capacity - a])):
            fill((a, capacity - a), n)
    if most > 1 and capacity % 2 == 0 and (n := int(left[capacity // 2] // 2)):
        fill((capacity // 2, capacity // 2), n)
    for a in range(capacity - 2, 0 if most > 2 else capacity, -1):
        rest = capacity - a
        low = np.arange(1, min(a, rest - 1) + 1)
        low = low[(rest - low <= low) & (left[low] > 0) & (left[rest - low] > 0)] if left[a] else low[:0]
        for b in low[::-1].tolist():
            c = rest - b
            need = {a: 0, b: 0, c: 0}
            for x in (a, b, c):
                need[x] += 1
            if n := int(min(left[x] // k for x, k in need.items())):
                fill((a, b, c), n)
            if not left[a]:
                break
    open_: dict[int, list[tuple[int, int]]] = {}  # free space -> (first sequence, sequences)
    spaces: list[int] = []

    def put(space: int, base: int, n: int) -> None:
        if space and n:
            if space not in open_:
                bisect.insort(spaces, space)
            open_.setdefault(space, []).append((base, n))

    for length in range(capacity, 0, -1):
        while left[length]:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                base, n = open_[space].pop()
                if not open_[space]:
                    del open_[space]
                    spaces.pop(at)
            else:
                space, base = capacity, sequences
                n = -(-int(left[length]) // (capacity // length))
                sequences += n
            each = space // length
            full = min(n, int(left[length]) // each)
            if full:
                take(length, full * each, each, base, capacity - space)
                put(space - each * length, base, full)
            if full < n and left[length]:
                some = int(left[length])
                take(length, some, some, base + full, capacity - space)
                put(space - some * length, base + full, 1)
                full += 1
            put(space, base + full, n - full)
    return np.array(sorted(segments), np.int64).reshape(-1, 5), sequences


def place(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to the rows of a staged table of pieces().

    Only counts of lengths go to the driver: at most capacity rows.
    """
    by = found.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    by = stage(by, "lengths")
    counts = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments, _ = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    by = by.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_base"))
    ranked = found.join(by, ["length", "chunk"]).withColumn("rank", F.col("rank_base") + F.col("nth"))
    ranked = ranked.drop("rank_base", "chunk", "nth")
    out = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", sequence_id long, offset long"
    keys = segments[:, 0] << 42 | segments[:, 1]

    def run(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            s = segments[np.searchsorted(keys, length << 42 | rank, "right") - 1]
            nth = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(f.name)) for f in out] + [pa.array(s[:, 3] + nth // s[:, 2]), pa.array(s[:, 4] + nth % s[:, 2] * length)],
                names=[f.name for f in out] + ["sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (little-endian unsigned 32-bit) and the documents in them."""
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("parts"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed(docs: DataFrame) -> DataFrame:
    """Digests of the packed pieces, each with its place."""
    import public_tokenizers

    found = pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    placed = place(found.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset")
