"""Token ids in sorted-string-table shards.

A shard is a run of blocks, then a sparse index, a Bloom filter and a footer of fixed size. A block
holds entries in key order, each key without the bytes it shares with the one before, compressed
and with a checksum. The index has each block's last key, so a lookup is a test of the Bloom
filter, a binary search in the index and a read of one block.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import AtomicFile, filesystem, new_path, stage
from ledgerloom.llm.tokens import encoder

MAGIC = b"LLSST001"
ENTRY = struct.Struct("<BBI")  # bytes shared with the key before, bytes of its own, ids
INDEX = struct.Struct("<9sQIII")  # last key, place, stored bytes, plain bytes, entries
FOOTER = struct.Struct("<QIQIQQBBI8s")  # index place, entries; filter place, bytes; documents, ids; id width, hashes; crc; magic
BLOCK_BYTES, BITS_A_KEY, HASHES = 256 << 10, 10, 7
#: Bytes of ids after which a task begins another shard.
SHARD_BYTES = 512 << 20


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes that sort as the identifiers do, null first."""
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def bloom_bits(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([(xxhash.xxh64_intdigest(k, 1), xxhash.xxh64_intdigest(k, 2) | 1) for k in keys], np.uint64).reshape(-1, 2)
    return (h[:, :1] + h[:, 1:] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    """Writes entries that come in key order; memory is a block, and nine bytes and a few bits a key."""

    def __init__(self, uri: str, width: int):
        self.file, self.width = AtomicFile(uri), width
        self.index: list[bytes] = []
        self.block, self.size, self.entries, self.last = [], 0, 0, b""
        self.keys, self.documents, self.ids = bytearray(), 0, 0
        self.file.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        key = key_of(doc_id)
        shared = 0
        while self.entries and shared < len(key) and key[shared] == self.last[shared]:
            shared += 1
        n = len(ids) // 4
        if self.width == 2:
            ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        self.block += [ENTRY.pack(shared, len(key) - shared, n), key[shared:], ids]
        self.size += len(ids)
        self.entries += 1
        self.last = key
        self.keys += key
        self.documents += 1
        self.ids += n
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            plain = b"".join(self.block)
            stored = pa.compress(plain, codec="zstd", asbytes=True)
            self.index.append(INDEX.pack(self.last, self.file.size, len(stored), len(plain), self.entries))
            self.file.write(stored + struct.pack("<I", zlib.crc32(stored)))
            self.block, self.size, self.entries = [], 0, 0

    def close(self) -> None:
        self._flush()
        at = self.file.size
        self.file.write(b"".join(self.index))
        bits = max(64, -(-self.documents * BITS_A_KEY // 64) * 64)
        words = np.zeros(bits, bool)
        for i in range(0, len(self.keys), 9 << 16):
            words[bloom_bits([bytes(self.keys[k : k + 9]) for k in range(i, min(len(self.keys), i + (9 << 16)), 9)], bits)] = True
        bloom = np.packbits(words, bitorder="little").tobytes()
        self.file.write(bloom)
        crc = zlib.crc32(bloom, zlib.crc32(b"".join(self.index)))
        self.file.write(FOOTER.pack(at, len(self.index), at + len(self.index) * INDEX.size, len(bloom), self.documents, self.ids, self.width, HASHES, crc, MAGIC))
        self.file.commit()

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()
        else:
            self.file.abort()


class Reader:
    """Reads a shard: whole, block by block, or the documents of one identifier."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        self.file.seek(end - FOOTER.size)
        at, blocks, bloom_at, bloom, self.documents, self.ids, self.width, _, crc, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard of this format")
        index = self.file.read_at(blocks * INDEX.size, at)
        self.bloom = self.file.read_at(bloom, bloom_at)
        if zlib.crc32(self.bloom, zlib.crc32(index)) != crc:
            raise ValueError(f"{uri}: its index is damaged")
        self.blocks = list(INDEX.iter_unpack(index))
        self.last_keys = [b[0] for b in self.blocks]

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, stored, plain, entries = self.blocks[k]
        data = self.file.read_at(stored + 4, at)
        if zlib.crc32(data[:stored]) != struct.unpack("<I", data[stored:])[0]:
            raise ValueError(f"block {k} is damaged")
        data = pa.decompress(data[:stored], decompressed_size=plain, codec="zstd", asbytes=True)
        at, key = 0, b""
        for _ in range(entries):
            shared, own, n = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            key = key[:shared] + data[at : at + own]
            at += own
            ids = data[at : at + n * self.width]
            at += n * self.width
            yield key, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if self.width == 2 else ids

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.blocks)):
            for key, ids in self.block(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of the documents with this identifier, in the order written."""
        key = key_of(doc_id)
        bits = bloom_bits([key], len(self.bloom) * 8)[0].tolist()
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in bits):
            return []
        found = []
        for k in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
            found += [ids for x, ids in self.block(k) if x == key]
            if self.last_keys[k] > key:
                break
        return found

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Encode the documents and write shards, one or more for each range of identifiers.

    Returns the staged manifest: shard, path, n_docs, n_ids, low, high. Ranges take the hash of the
    text as a second key, so an identifier with very many rows is spread over shards, and a task
    begins another shard after SHARD_BYTES. Null and empty texts have the end id alone; null
    identifiers come first; repeated rows are kept.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "sstable")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = (pa.int64(), pa.string(), *[pa.int64()] * 4)

    def run(batches):
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        end, width = struct.pack("<I", end_id), 2 if max(enc.vocabulary, end_id + 1) <= 65536 else 4
        rows = ((k, ids + end) for batch in batches for k, ids in zip(batch.column(0).to_pylist(), enc.encode_column(batch.column(1))))
        row, nth = next(rows, None), 0
        while row:
            path, low = f"{folder}/shard-{task:06d}-{nth:06d}.sst", row[0]
            with Writer(path, width) as out:
                while row and out.ids * width < SHARD_BYTES:
                    out.add(*row)
                    high, row = row[0], next(rows, None)
            values = ([task << 24 | nth], [path], [out.documents], [out.ids], [low], [high])
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["shard", "path", "n_docs", "n_ids", "low", "high"])
            nth += 1

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return stage(dealt.mapInArrow(run, "shard long, path string, n_docs long, n_ids long, low long, high long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """All documents of the shards: doc_id, start (ids before it), ids.

    Only the manifest, a row a shard, is summed up in one place.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    summed = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    n = max(1, manifest.count())

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows, size, reader = [], 0, Reader(path)
                for doc_id, ids in reader:
                    rows.append((doc_id, start, ids))
                    start += len(ids) // 4
                    size += len(ids)
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                reader.close()
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "ids"])

    return summed.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, ids binary")


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, ids of the rows with the identifiers in keys(doc_id), by binary search.

    Of the manifest, the driver takes a row a shard.
    """
    shards = [(r["path"], key_of(r["low"]), key_of(r["high"])) for r in manifest.orderBy("shard").collect()]
    lows, highs = [s[1] for s in shards], [s[2] for s in shards]

    def run(batches):
        open_: dict[str, Reader] = {}
        for batch in batches:
            found = []
            for doc_id in batch.column(0).to_pylist():
                key = key_of(doc_id)
                for path, _, _ in shards[bisect.bisect_left(highs, key) : bisect.bisect_right(lows, key)]:
                    reader = open_.get(path) or open_.setdefault(path, Reader(path))
                    found += [(doc_id, ids) for ids in reader.get(doc_id)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["doc_id", "ids"])

    return keys.select(F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, ids binary")


def digests(docs: DataFrame) -> DataFrame:
    """Write the documents, read the shards back and give each document's digest."""
    import public_tokenizers

    out = read_shards(write_shards(docs, public_tokenizers.path("byte_bpe_50k.json")))
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_sstable_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
