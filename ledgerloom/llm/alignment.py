"""How the tokens of two tokenisers lie over each other, aligned by DuckDB within each Arrow partition.

A partition's texts go in blocks of bounded size. Both tokenisers always start a token at some line
ends and blanks, so a block's texts are strings of runs between such places, and each distinct run
that a worker meets is tokenised and aligned once. Its tokens are intervals of bytes, laid end to end: an
as-of join finds the token of A that a token of B begins in, a range join those that begin inside
one of B, window sums number the groups between common ends. Blocks count their linked id pairs;
Spark merges the counts, and gives each block back those of its own pairs.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import drop, stage
from ledgerloom.llm.tokens import Encoder, cuts, ranges

#: Bytes of text in a block at most, beyond one text; bytes of new runs that are aligned together; runs that a worker remembers.
BLOCK, PART, SEEN = 4 << 20, 256 << 10, 400_000
#: Slots of the encoder's own memory: runs are remembered here already.
SLOTS = 1 << 17
DOC, PAIR, LINKS = range(3)
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
#: Rows of three kinds: documents with their distinct runs, id pairs of a block, and its links by run and pair.
SCHEMA = pa.schema(
    [("block", pa.int64()), ("kind", pa.int8()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string())]
    + [("runs", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("pair", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]
)
DDL = "block long, kind byte, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, runs array<int>, times array<long>, pair int, a int, b int, n long"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

#: a and b hold run, id, s, e: the run, the token's id, its first byte and the byte after it, over the part.
LINKED = """
SELECT b.run, a.id AS a, b.id AS b FROM b ASOF JOIN a ON b.s >= a.s
UNION ALL
SELECT a.run, a.id, b.id FROM a JOIN b ON a.s > b.s AND a.s < b.e
"""
GROUPED = """
WITH tokens AS (
  SELECT 0 AS side, a.*, b.e IS NOT NULL AS last FROM a LEFT JOIN b ON a.e = b.e
  UNION ALL
  SELECT 1, b.*, a.e IS NOT NULL FROM b LEFT JOIN a ON a.e = b.e),
numbered AS (
  SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY side ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM tokens)
SELECT run, side, id, last FROM numbered ORDER BY grp, side, s
"""
#: What follows a token's id: between tokens of a group, after its last of A, and after its last of B.
_ENDS = np.array([b",", b"|", b";"])


class Pool:
    """The bytes of each token id, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.at[ids], self.size[ids])]


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenisers: ids of runs, and the bytes of ids."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a = Encoder(a, True, SLOTS)
        byte, vocabulary = byte_level(), self.a.tokenizer.get_vocab()
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            spelled[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.a_pool = Pool(spelled)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_pool = Pool([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        #: no piece goes over a place before a blank that follows another character, or touches a line end
        self.apart = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)

    def encode(self, runs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of the runs end to end and how many each has, by A and by B. Each run starts with a blank or a line end."""
        found = list(self.a.encode_array(pa.array([r.decode() for r in runs], pa.large_string())))
        ids = np.concatenate([x[1] for x in found]).astype(np.int64)
        n = np.concatenate([np.diff(x[2]) for x in found])
        blank = [r[:1] == b" " for r in runs]  # B puts a blank before the text by itself
        other = self.b.encode([(r[1:] if k else r).decode() for r, k in zip(runs, blank)], num_threads=1)
        other = [x if k else x[1:] for x, k in zip(other, blank)]
        m = np.fromiter(map(len, other), np.int64, len(other))
        return [(ids, n), (np.fromiter(itertools.chain.from_iterable(other), np.int64, int(m.sum())), m)]


def places(d: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where runs start in the texts' bytes d, which start at bounds: there both tokenisers start a token."""
    at = cuts(d, bounds)
    at = at[at < len(d) - 1]
    inside = ~np.isin(at + 1, bounds)
    blank = (d[at] == 32) & (d[at + 1] != 32) & (d[at + 1] != 10) & inside
    mark = np.zeros(len(d), bool)
    mark[at[(blank | (d[at] == 10)) & (d[at - 1] != 32)]] = True  # no run is a blank alone
    mark[bounds[bounds < len(d)]] = True
    return np.flatnonzero(mark)


def whole(pool: Pool, ids: np.ndarray, n: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which runs, end to end in data, are spelled by their tokens."""
    of = np.repeat(np.arange(len(n)), n)
    ok = np.bincount(of, pool.size[ids], len(n)).astype(np.int64) == size
    wrong = pool.spell(ids[ok[of]]) != data[ok[np.repeat(np.arange(len(size)), size)]]
    ok[np.repeat(np.flatnonzero(ok), size[ok])[wrong]] = False
    return ok


class Runs:
    """Distinct runs that a worker has met, with their tokens, groups and links; all forgotten between blocks once they are many."""

    def __init__(self, pair: Pair, con):
        self.pair, self.con = pair, con
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.lines: list[bytes] = []
        #: by run: n_a, n_b, n_groups, n_links; whether both sides spell it; where its links begin
        self.counts, self.ok, self.at = np.zeros((4, 0), np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        self.links, self.held = np.zeros((2, 1 << 16), np.int32), 0

    def number(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each run of the texts, end to end, and the place of each text's first."""
        if len(self.known) > SEEN:
            self.forget()
        bounds, data = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))), b"".join(texts)
        at = places(np.frombuffer(data, np.uint8), bounds) if self.pair.apart else bounds[:-1]
        known, ends = self.known, itertools.chain(at[1:].tolist(), (len(data),))
        run = np.fromiter((known.setdefault(data[x:y], len(known)) for x, y in zip(at.tolist(), ends)), np.int64, len(at))
        part, size = [], 0
        for r in itertools.islice(known, len(self.lines), None):
            if part and size + len(r) > PART:
                self._align(part)
                part, size = [], 0
            part.append(r)
            size += len(r)
        if part:
            self._align(part)
        return run, np.searchsorted(at, bounds)

    def _align(self, runs: list[bytes]) -> None:
        """Learn the tokens, groups and links of new runs."""
        size, data = np.fromiter(map(len, runs), np.int64, len(runs)), np.frombuffer(b"".join(runs), np.uint8)
        pools, found = (self.pair.a_pool, self.pair.b_pool), self.pair.encode(runs)
        ok = np.logical_and(*(whole(pool, ids, n, size, data) for pool, (ids, n) in zip(pools, found)))
        for name, pool, (ids, n) in zip("ab", pools, found):
            of = np.repeat(np.arange(len(runs)), n)
            ids, of = ids[ok[of]], of[ok[of]]
            e = np.cumsum(pool.size[ids])
            self.con.register(name, pa.table({"run": of, "id": ids.astype(np.int32), "s": e - pool.size[ids], "e": e}))
        run, *ids = (x.to_numpy() for x in self.con.sql(LINKED).to_arrow_table().columns)
        order = np.argsort(run, kind="stable")
        while self.held + len(run) > self.links.shape[1]:
            self.links = np.concatenate([self.links, np.zeros_like(self.links)], axis=1)
        self.links[:, self.held : self.held + len(run)] = np.stack(ids)[:, order]
        counts = np.zeros((4, len(runs)), np.int64)
        counts[3] = np.bincount(run, minlength=len(runs))
        self.at = np.append(self.at, self.held + np.cumsum(counts[3]) - counts[3])
        self.held += len(run)
        run, side, ids, last = (x.to_numpy() for x in self.con.sql(GROUPED).to_arrow_table().columns)
        for k, some in enumerate((side == 0, side == 1, last & (side == 0))):
            counts[k] = np.bincount(run[some], minlength=len(runs))
        spelled = [b"%d%s" % x for x in zip(ids.tolist(), _ENDS[np.where(last, 1 + side, 0)].tolist())]
        ends = np.cumsum(counts[0] + counts[1]).tolist()
        lines = [b"".join(spelled[x:y]) for x, y in zip([0, *ends], ends)]
        self.counts, self.ok = np.concatenate([self.counts, counts], axis=1), np.append(self.ok, ok)
        self.lines += lines


@functools.lru_cache(maxsize=1)
def worker(a: str, b: str) -> Runs:
    """One memory of runs, with its database, a Python worker."""
    import duckdb

    return Runs(Pair(a, b), duckdb.connect(config={"threads": 1}))


def aligned(seen: Runs, ids: list[int | None], texts: list[str | None], block: int):
    """The rows of one block. Its own runs and pairs are numbered from 0."""
    full = [k for k, t in enumerate(texts) if t]
    run, first = seen.number([b" " + texts[k].encode() for k in full])
    own, of = np.unique(run, return_inverse=True)
    counts, ok, weight = seen.counts[:, own], seen.ok[own], np.zeros(len(own), np.int64)
    rows = [{"block": block, "kind": DOC, "doc_id": i, **dict.fromkeys(COUNTS, 0), "groups_sha256": ""} for i in ids]
    for x, y, k in zip(first.tolist(), first[1:].tolist(), full):
        mine, times = np.unique(of[x:y], return_counts=True)
        if not ok[mine].all():
            continue
        weight[mine] += times
        line = b"".join([seen.lines[r] for r in run[x:y].tolist()])[:-1]
        sums = (counts[:, mine] * times).sum(axis=1).tolist()
        rows[k] |= dict(zip(COUNTS, sums)) | {"groups_sha256": hashlib.sha256(line).hexdigest(), "runs": mine, "times": times}
    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
    a, b = seen.links[:, ranges(seen.at[own], counts[3])].astype(np.int64)
    linked = np.repeat(np.arange(len(own)), counts[3])
    both, pair = np.unique(a << 32 | b, return_inverse=True)
    n = np.zeros(len(both), np.int64)
    np.add.at(n, pair, weight[linked])
    columns = {"pair": np.arange(len(both)), "a": both >> 32, "b": both & 0xFFFFFFFF, "n": n}
    yield _rows(block, PAIR, len(both), columns)
    yield _rows(block, LINKS, 1, {"runs": [linked], "times": [pair]})


def _rows(block: int, kind: int, n: int, columns: dict) -> pa.RecordBatch:
    columns = {"block": np.full(n, block), "kind": np.full(n, kind)} | columns
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SCHEMA], schema=SCHEMA)


def blocks(docs: DataFrame, a: str, b: str, block_bytes: int = BLOCK) -> DataFrame:
    """Rows of all blocks; a block's number is its task's and its place there."""

    def run(batches):
        seen, number = worker(a, b), TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                size = len(t.as_buffer()) if t.is_valid else 0
                if texts and held + size > block_bytes:
                    yield from aligned(seen, ids, texts, number)
                    ids, texts, held, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(t.as_py())
                held += size
        if texts:
            yield from aligned(seen, ids, texts, number)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DDL)


def scored(key, found: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block with sums over the corpus-wide counts of its pairs."""
    kind = found.column("kind").to_numpy()
    docs = found.filter(pa.array(kind == DOC))
    links = found.filter(pa.array(kind == LINKS))
    run, pair = (links.column(c).combine_chunks().flatten().to_numpy() for c in ("runs", "times"))
    order = np.argsort(counts.column("pair").to_numpy())
    by_pair = np.stack([counts.column(c).to_numpy()[order].astype(np.int64) for c in ("best", "count")])
    by_run = np.zeros((2, int(run.max(initial=-1)) + 1), np.int64)
    for k in range(2):
        np.add.at(by_run[k], run, by_pair[k][pair])
    sums = np.zeros((2, docs.num_rows), np.int64)
    for k, (runs, times) in enumerate(zip(docs.column("runs"), docs.column("times"))):
        if runs.is_valid:
            sums[:, k] = (by_run[:, runs.values.to_numpy()] * times.values.to_numpy()).sum(axis=1)
    columns = [docs.column(c) for c in ("doc_id", *COUNTS)] + [pa.array(sums[0]), pa.array(sums[1]), docs.column("groups_sha256")]
    return pa.table(columns, names=[c.split()[0] for c in OUT.split(", ")])


def alignment(docs: DataFrame, a: str, b: str, block_bytes: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level vocabulary of the tokenizers library and encodes a blank and the text, B a
    sentencepiece model that puts the blank there itself; strings of special tokens are text.
    Tokens whose bytes overlap are linked; a pair's count is that of its links in all documents,
    and n_best counts links of a pair that no other pair with the same id of B exceeds. Null and empty
    texts, and those that either side can't spell, have no tokens: zeros and an empty digest, and
    they count for nothing. A null doc_id is kept; rows that repeat a doc_id are documents of their
    own. Without documents there are no rows; other columns are ignored.
    """
    found = stage(blocks(docs, a, b, block_bytes), "aligned")
    pairs = found.where(F.col("kind") == PAIR).select("block", "pair", "a", "b", "n")
    counts = stage(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair_counts")
    most = F.broadcast(counts.groupBy("b").agg(F.max("count").alias("most")))  # B's vocabulary has no more rows
    best = (F.col("count") == F.col("most")).cast("long").alias("best")
    own = stage(pairs.join(counts, ["a", "b"]).join(most, "b").select("block", "pair", "count", best), "block_counts")
    rest = found.where(F.col("kind") != PAIR).select("block", "kind", "doc_id", *COUNTS, "groups_sha256", "runs", "times")
    out = stage(rest.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(scored, OUT), "aligned_documents")
    drop(found, counts, own)
    return out


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document's tokens by byte_bpe_50k and piece_bpe_32k; see alignment()."""
    import public_tokenizers

    a, b = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), a, b)
