"""Shards, flat token files and archives: exact round trips."""

import base64
import hashlib
import re
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import sepscan, sstable, warc

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def test_shards_give_every_document_back(spark, library):
    rows = sorted(tuple(r) for r in sstable.op10_sstable_output(spark, SF).collect())
    at = 0
    for (doc_id, start, n, crc), want in zip(rows, spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = ids_of(library, want["text"]) + [0]
        assert (doc_id, start, n, crc) == (want["doc_id"], at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += n


def test_lookup_nulls_repeats_and_empty_tables(spark, library, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 64)
    rows = [(i * 3 - 50, f"text number {i} " * 9) for i in range(300)] + [(7, "a"), (7, "a"), (7, "b"), (None, "z"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS tie")
    manifest = sstable.write_shards(docs, PATH, partitions=5)
    keys = spark.createDataFrame([(i,) for i in range(-60, 900)] + [(None,)], "doc_id long")
    found = sorted(((r["doc_id"], bytes(r["ids"])) for r in sstable.lookup(manifest, keys).collect()), key=str)
    want = sorted(((i, struct.pack(f"<{len(x)}I", *x)) for i, t in rows for x in [ids_of(library, t) + [0]]), key=str)
    assert found == want
    assert sstable.digests(docs).where("doc_id IS NULL AND start = 0").count() == 1
    assert sstable.digests(docs.where("false")).count() == 0


def test_tasks_begin_another_shard_by_bytes(spark, library, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BYTES", 3000)
    rows = [(i, f"text number {i} " * 30) for i in range(200)] + [(500, "long " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = sstable.write_shards(docs, PATH, partitions=3)
    assert manifest.count() > 9
    at = 0
    for r, (i, text) in zip(sstable.read_shards(manifest).orderBy("doc_id").collect(), rows, strict=True):
        ids = ids_of(library, text) + [0]
        assert (r["doc_id"], r["start"], bytes(r["ids"])) == (i, at, struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    keys = spark.createDataFrame([(i,) for i in range(0, 600, 7)], "doc_id long")
    assert {r["doc_id"] for r in sstable.lookup(manifest, keys).collect()} == {i for i, _ in rows if i % 7 == 0}


def test_a_failed_writer_leaves_no_file(tmp_path):
    with pytest.raises(KeyError):
        with sstable.Writer(str(tmp_path / "x.sst"), 4) as w:
            w.add(1, b"\0" * 4)
            raise KeyError
    assert list(tmp_path.iterdir()) == []


def test_a_damaged_block_is_noticed(tmp_path):
    w = sstable.Writer(str(tmp_path / "x.sst"), 4)
    for i in range(1000):
        w.add(i, struct.pack("<2I", i, 70000))
    w.close()
    data = bytearray((tmp_path / "x.sst").read_bytes())
    r = sstable.Reader(str(tmp_path / "x.sst"))
    assert r.get(5) == [struct.pack("<2I", 5, 70000)] and r.get(5000) == [] and sum(1 for _ in r) == 1000
    data[20] ^= 1
    (tmp_path / "y.sst").write_bytes(data)
    with pytest.raises(ValueError):
        list(sstable.Reader(str(tmp_path / "y.sst")))


@pytest.mark.parametrize("block", [4, 20, 4 << 20])
def test_separator_scan_counts(spark, library, block):
    rows = [(i, "word " * (i % 23)) for i in range(40)] + [(1, "!<|endoftext|>!!"), (None, "q"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS path").repartition(3)
    library.encode_special_tokens = True
    want = sorted(((i, len(ids_of(library, t)) + 1) for i, t in rows), key=str)
    library.encode_special_tokens = False
    assert sorted((tuple(r) for r in sepscan.token_counts(docs, PATH, 50256, block).collect()), key=str) == want
    assert sorted((tuple(r) for r in sepscan.token_counts(docs, PATH, 50256, block, 2).collect()), key=str) == want
    assert sepscan.token_counts(docs.where("false"), PATH, 50256).count() == 0


def test_blocks_hold_whole_ids(spark):
    with pytest.raises(ValueError):
        sepscan.scan_flat(spark.createDataFrame([], "path string, size long"), 0, 6)


def test_separator_scan_of_foreign_files(spark, tmp_path):
    rows = []
    for k, ids in enumerate(([5, 5, 0, 0, 7], [0], [3], [])):
        (tmp_path / f"{k}").write_bytes(struct.pack(f"<{len(ids)}I", *ids))
        rows.append((str(tmp_path / f"{k}"), 4 * len(ids)))
    out = sepscan.scan_flat(spark.createDataFrame(rows, "path string, size long"), 0, 8)
    found = sorted((r["path"][-1], r["ordinal"], r["n_tokens"], r["ended"]) for r in out.collect())
    assert found == [("0", 0, 3, True), ("0", 1, 1, True), ("0", 2, 1, False), ("1", 0, 1, True), ("2", 0, 1, False)]


def test_query_counts(spark, library):
    got = {r["doc_id"]: r["n_tokens"] for r in sepscan.op6_separator_scan(spark, SF).collect()}
    library.encode_special_tokens = True
    assert got == {r["doc_id"]: len(ids_of(library, r["text"])) + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows, least=0):
    out = []
    for page, html in rows:
        payload = (html or "").encode()
        same = [p for p, h in rows if (h or "").encode() == payload]
        top = max((p for p in same if p is not None), default=None)
        revisit = len(payload) >= least and top is not None and page != top
        out.append((page, len(payload), sha1(payload), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 3])
def test_archive(spark, least):
    rows = [(1, "<p>é</p>"), (2, None), (3, ""), (4, "<p>é</p>"), (5, "ab"), (6, "ab"), (6, "ab"), (None, "ab"), (None, "only"), (9, "x" * 99999)]
    pages = spark.createDataFrame([(p, f"http://e/{p}\r\nX: 1", h) for p, h in rows], "page_id long, url string, html string").withColumn("size", F.lit(1))
    folder = warc.write_archive(pages, least)
    records = warc.read_archive(spark, folder)
    assert sorted((tuple(r) for r in warc.fields(records).collect()), key=str) == brute(rows, least)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({(h or "") for _, h in rows})
    whole = warc.record_bytes(records).collect()
    ids = [re.search(rb"WARC-Record-ID: (\S+)", bytes(r["record"]))[1] for r in whole]
    assert len(set(ids)) == len(rows)
    refers = {m[1] for r in whole if (m := re.search(rb"WARC-Refers-To: (\S+)", bytes(r["record"])))}
    assert refers and refers <= set(ids)
    for r in whole:
        assert re.search(rb"\r\nWARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", bytes(r["record"]))
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert body[length:] == b"\r\n\r\n" and len(body) == length + 4
        kind = b"WARC-Type: revisit" in head
        assert body[:length] == r["http"].encode() + (b"" if kind else bytes(r["payload"]))
    assert warc.fields(warc.read_archive(spark, warc.write_archive(pages.where("false")))).count() == 0


def test_archive_query(spark):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in warc.op8_content_addressed_warc(spark, SF).collect()), key=str) == brute(rows)


def test_reading_what_headers_say_shuffles_no_payload(spark):
    pages = spark.createDataFrame([(k, "u", "x" * k) for k in range(9)], "page_id long, url string, html string")
    records = warc.read_archive(spark, warc.write_archive(pages))
    said = warc.fields(records)
    plan = spark._jvm.PythonSQLUtils.explainString(said._jdf.queryExecution(), "formatted")
    moved = re.findall(r"(?:Exchange|Join)[^\n]*\n(?:Input|Left keys|Output)[^\n]*", plan)
    assert moved and not any("payload" in m for m in moved)


def test_a_payload_that_was_changed_stops_the_read(spark):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    folder = warc.write_archive(pages)
    address = spark.read.parquet(f"{folder}/payloads").first()["address"]
    spark.createDataFrame([(address, b"abd")], "address string, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    for c in ("payload_bytes", "payload_digest"):
        with pytest.raises(Exception, match="match its address"):
            warc.fields(warc.read_archive(spark, folder)).select(c).collect()
