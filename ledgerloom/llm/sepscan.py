"""Document lengths in flat token files that have no index, by a scan for the end-of-document id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import AtomicFile, filesystem, new_path, stage
from ledgerloom.llm.tokens import encoder

BLOCK_BYTES = 4 << 20


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, width: int = 4) -> DataFrame:
    """Write the documents' ids, each document closed by end_id, to a flat file a partition.

    Files hold little-endian unsigned ids of width bytes, 2 or 4, and nothing else. Returns the staged keys: doc_id,
    path, ordinal (the document's place in its file), size (of the file so far, in bytes). The
    string of an added token in a text is ordinary text, so end_id stands for ends alone.
    """
    if width not in (2, 4):
        raise ValueError("ids have 2 or 4 bytes")
    folder = new_path(docs.sparkSession, "flat")

    def run(batches):
        enc = encoder(tokenizer, True)
        if width == 2 and max(enc.vocabulary - 1, end_id) >= 1 << 16:
            raise ValueError("the vocabulary needs four bytes an id")
        path, ordinal, batch = f"{folder}/part-{TaskContext.get().partitionId():06d}.ids", 0, next(batches, None)
        if batch is None:
            return
        with AtomicFile(path) as out:
            while batch is not None:
                sizes = []
                for _, ids, begin in enc.encode_array(batch.column(1)):
                    sizes.append(out.size + (begin[1:] + np.arange(1, len(begin))) * width)
                    out.write(np.insert(ids, begin[1:], end_id).astype(f"<u{width}").tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([path] * n), pa.array(np.arange(ordinal, ordinal + n)), pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]))],
                    names=["doc_id", "path", "ordinal", "size"],
                )
                ordinal += n
                batch = next(batches, None)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stage(rows.mapInArrow(run, "doc_id long, path string, ordinal long, size long"), "keys")


def scan_flat(files: DataFrame, end_id: int, block_bytes: int = BLOCK_BYTES, width: int = 4) -> DataFrame:
    """One row a document of files(path, size): path, ordinal, n_tokens (with its end), ended.

    Each block of a file is a task's row of its own: numpy finds the ends in it, and the places of
    the last end and the number of ends before a block follow by a prefix scan over the blocks of a
    file. Ids after the last end are a document with ended false; an empty file has none.
    block_bytes is a multiple of width.
    """
    if block_bytes <= 0 or block_bytes % width:
        raise ValueError("a block holds a whole number of ids")
    blocks = files.where("size > 0").select("path", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_bytes).cast("long"))).alias("block", "at"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(n, "path", "block")

    def run(batches):
        for batch in batches:
            for path, size, block, at in zip(*(c.to_pylist() for c in batch.columns)):
                fs, local = filesystem(path)
                with fs.open_input_file(local) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, size - at), at), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + at // width
                values = ([path], [block], [size // width], [len(ends)], [int(ends[0]) if len(ends) else None], [int(ends[-1]) if len(ends) else None], [np.diff(ends)])
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["path", "block", "total", "n", "first", "last", "inner"])

    scanned = stage(blocks.mapInArrow(run, "path string, block long, total long, n long, first long, last long, inner array<long>"), "scanned")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = scanned.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"))
    docs = scanned.where("n > 0").join(scan, ["path", "block"])
    docs = docs.select("path", "base", F.posexplode(F.concat(F.array(F.col("first") - F.col("previous")), "inner")).alias("k", "n_tokens"))
    docs = docs.select("path", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = scanned.groupBy("path").agg(F.sum("n").alias("ordinal"), (F.max("total") - 1 - F.coalesce(F.max("last"), F.lit(-1))).alias("n_tokens"))
    return docs.union(rest.where("n_tokens > 0").select("path", "ordinal", "n_tokens", F.lit(False)))


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, block_bytes: int = BLOCK_BYTES, width: int = 4) -> DataFrame:
    """doc_id, n_tokens (with the end id) as scanned from flat files of the documents.

    Null and empty texts count 1; null identifiers and repeated rows are kept.
    """
    keys = write_flat(docs, tokenizer, end_id, width)
    found = scan_flat(keys.groupBy("path").agg(F.max("size").alias("size")), end_id, block_bytes, width)
    return keys.join(found, ["path", "ordinal"]).select("doc_id", "n_tokens")


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 50256, width=2)
