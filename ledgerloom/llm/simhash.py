"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint's 64 bits fall into three segments, each read as a word of the perfect binary Golay
code of length 23. Two words that differ in two bits at most have a third within one bit of both,
so the codewords nearest to the words within one bit of each have one in common: a word has one
such codeword or six. Of three segments that differ in two bits together one is equal, which makes
a key of an equal segment and a codeword number of the next. Pairs that share a key are verified.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.minhash import components
from ledgerloom.llm.shared import drop, stage

SHINGLE, SEED = 3, 42
#: Lowest bit and width of each segment; bits beyond its width are zero in the code's word.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the code, and its length.
POLYNOMIAL, LENGTH = 0b110001110101, 23
#: Differing bits of linked fingerprints at most; the code's keys are made for two.
BITS = 2
#: Fingerprints of a key that are compared with one another; those of a larger one meet at midpoints.
CROWD = 256
#: Shingles hashed before their bits are counted.
TOGETHER = 1 << 15


def fingerprint(text: str | None) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's shingles; without words 0.

    Words are runs without ASCII white space, A-Z in lower case. Shingles of three words count as
    often as they occur; fewer words make one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = min(SHINGLE, len(words))
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - n + 1], ends[n - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), TOGETHER):
        spans = zip(starts[at : at + TOGETHER].tolist(), ends[at : at + TOGETHER].tolist())
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


@functools.cache
def code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of a word's low 12 and high 11 bits, and for each remainder what leads to the codewords
    nearest to the words within one bit: six masks, the first one repeated where there is but one codeword.
    """
    power = [1]
    for _ in range(LENGTH - 1):
        x = power[-1] << 1
        power.append(x ^ POLYNOMIAL if x >> 11 else x)
    low, high = np.zeros(1 << 12, np.uint32), np.zeros(1 << 11, np.uint32)
    for b, x in enumerate(power):
        table, bit = (low, b) if b < 12 else (high, b - 12)
        table[np.arange(len(table)) >> bit & 1 == 1] ^= np.uint32(x)
    nearest = np.zeros(1 << 11, np.uint32)  # the one mask of three bits at most for each remainder
    for n in range(4):
        for bits in itertools.combinations(range(LENGTH), n):
            nearest[functools.reduce(lambda s, b: s ^ power[b], bits, 0)] = sum(1 << b for b in bits)
    masks = np.zeros((1 << 11, 6), np.uint32)
    for s in range(1 << 11):
        found = {int(nearest[s]): None} | {int(nearest[s ^ power[b]]) ^ 1 << b: None for b in range(LENGTH)}
        masks[s] = [*found, *[next(iter(found))] * (6 - len(found))]
    return low, high, masks


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the six codewords near each word, and which of them count: all, or the first alone."""
    low, high, masks = code()
    words = words.astype(np.uint32)
    near = masks[low[words & np.uint32(0xFFF)] ^ high[words >> np.uint32(12)]]
    ok = near != near[:, :1]
    ok[:, 0] = True
    return (words[:, None] ^ near) >> np.uint32(LENGTH - 12), ok


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the fingerprints, and a key of each: segment, its value, a codeword number of the next segment."""
    parts = [prints >> np.uint64(low) & np.uint64((1 << width) - 1) for low, width in SEGMENTS]
    at, out = [], []
    for k, part in enumerate(parts):
        number, ok = codewords(parts[(k + 1) % len(parts)])
        key = np.uint64(k) << np.uint64(34) | part[:, None] << np.uint64(12) | number.astype(np.uint64)
        at.append(np.nonzero(ok)[0])
        out.append(key[ok])
    return np.concatenate(at), np.concatenate(out)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the text's fingerprint as a signed number."""

    def run(batches):
        for b in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, print long")


def _keyed(prints: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            at, key = keys(b.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(key.view(np.int64))], names=["print", "key"])

    return prints.mapInArrow(run, "print long, key long")


def _near(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """Pairs (a, b) of one key's fingerprints that differ in few enough bits; the test is part of the join."""
    a, b = (rows.select(key, F.col("print").alias(c)) for c in "ab")
    few: Column = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    return a.join(b, key).where((F.col("a") < F.col("b")) & few).select("a", "b")


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints given that differ in BITS bits at most, as a staged table.

    Fingerprints of a key with over crowd of them are compared at midpoints instead: each goes to
    the 65 words within one bit of it, and two that differ in two bits or less meet at one. No word
    has over 65 fingerprints near it, so the work on a crowd is linear in its members.
    """
    keyed = stage(_keyed(prints), "keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = stage(keyed.join(sizes, "key"), "shared_keys")
    some = _near(shared.where(F.col("members") <= crowd), "key", BITS)
    crowded = shared.where(F.col("members") > crowd).select("print").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("print").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    middles = crowded.select("print", F.explode(F.concat(F.array("print"), flips)).alias("middle"))
    found = stage(some.union(_near(middles, "middle", BITS)).distinct(), "links")
    drop(keyed, shared)
    return found


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Documents whose fingerprints differ in two bits at most are linked; component_id is the smallest
    doc_id that a document reaches. Null texts and texts without words have fingerprint zero and are
    linked like any others. A null doc_id is kept and links its document too, but is no component's
    id; that is null where no document of a component has an id. Rows that repeat a doc_id are
    documents of their own. Without documents there are no rows; other columns are ignored.
    """
    rows = stage(fingerprints(docs), "fingerprints")
    first = stage(rows.groupBy("print").agg(F.min("doc_id").alias("low")), "prints")
    pairs = links(first.select("print"), crowd)
    comps = components(pairs)
    least = comps.join(first, comps["node"] == first["print"]).groupBy("comp").agg(F.min("low").alias("least"))
    linked = comps.join(least, "comp").select(F.col("node").alias("print"), "least")
    of = first.join(linked, "print", "left").select("print", F.coalesce("least", "low").alias("component_id"))
    drop(pairs)
    return rows.join(of, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op11_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see near_duplicates()."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
