import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing, tokens

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([7, 64, 2048])
    counts = {length: rng.randint(1, 60) for length in rng.sample(range(1, cap + 1), min(cap, 40))}
    segments, n = packing.plan(counts, cap)
    used = defaultdict(list)
    for length, total in counts.items():
        own = [s for s in segments.tolist() if s[0] == length]
        for k, (_, first, each, base, offset) in enumerate(own):
            end = own[k + 1][1] if k + 1 < len(own) else total
            for r in range(end - first):
                used[base + r // each].append((offset + r % each * length, length))
        assert own[0][1] == 0
    assert set(used) == set(range(n))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    assert n <= first_fit_decreasing(counts, cap) + 1


def first_fit_decreasing(counts, cap):
    free = []
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        at = next((i for i, x in enumerate(free) if x >= length), None)
        if at is None:
            free.append(cap - length)
        else:
            free[at] -= length
    return len(free)


def test_query_against_the_library(spark):
    rows = packing.op2_best_fit_packing(spark, SF).collect()
    texts = dict(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    t = Tokenizer.from_file(PATH)
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == set(texts)
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == [sum(p["length"] for p in parts[:k]) for k in range(len(parts))]
        assert sum(r["length"] for r in parts) == len(ids)
        assert len(ids) > 2048 or len(parts) == 1
        assert all(r["length"] == 2048 for r in parts[1:])
        for r in parts:
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 1


ODD = ["", "a", "b word, word. word x, x. 1, é. , . ,, w's, don't. ʼn, Ⅷ, ².", " a  b ", "a\n b \tc", "x <|endoftext|> y", "é  ü", "don't 12 %% it's", " lead", "trail ", "a  b", "a\x1c b", "\U0001f600 \U0001f600", "a b　 c"]


def test_memo_gives_the_same_ids():
    t, e = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    for text in ODD + ODD[::-1]:
        ids = t.encode(text, add_special_tokens=False).ids
        assert e.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text
    many = [*ODD, None, *ODD]
    assert list(e.encode_column(pa.array(many))) == [e.encode(x) for x in many] == tokens.Encoder(PATH).encode_many(many)


ATOMS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "b", "the", "é", "x", "1", "23", "'s", "'", ",", "...", "!!", "\u3000", "\xa0", "\u2028", "\x85", "\x1c", "\x00", "×", "÷", "²", "Ⅷ", "“", "—", "😀", "中", "ʼn", "ö", "ß", "<|endoftext|>", "ٱ", "ा", "À", " The", "\x7f"]


@pytest.mark.parametrize("slots,together,longest", [(256, 2 << 20, 14), (1024, 64, 300), (2048, 500, 2000)])
def test_any_text_has_the_library_ids(monkeypatch, slots, together, longest):
    """Pieces forgotten at every turn, texts of one batch side by side, and long texts in parts."""
    monkeypatch.setattr(tokens, "TOGETHER", together)
    t, e, rng = Tokenizer.from_file(PATH), tokens.Encoder(PATH, slots=slots), random.Random(slots)
    for _ in range(120):
        many = ["".join(rng.choice(ATOMS[: rng.choice([20, 41])]) for _ in range(rng.randint(0, longest))) for _ in range(rng.randint(1, 9))]
        many = [x.replace("<|endoftext|>", "") if rng.random() < 0.9 else x for x in many]
        for x, got in zip(many, e.encode_many(many), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def exact(lengths, cap):
    """The least number of sequences, by trying all places of each length."""
    best = len(lengths)

    def go(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(lengths):
            best = len(free)
            return
        for i in {x: i for i, x in enumerate(free) if x >= lengths[k]}.values():
            go(k + 1, [*free[:i], free[i] - lengths[k], *free[i + 1 :]])
        go(k + 1, [*free, cap - lengths[k]])

    go(0, [])
    return best


def test_plan_is_the_least_on_small_instances():
    rng = random.Random(3)
    over = 0
    for _ in range(300):
        cap = rng.randint(8, 30)
        lengths = sorted((rng.randint(1, cap) for _ in range(rng.randint(1, 9))), reverse=True)
        n, least = packing.plan({x: lengths.count(x) for x in lengths}, cap)[1], exact(lengths, cap)
        assert least <= n <= least + 1
        over += n > least
    assert over <= 3


def test_very_long_text_is_cut_into_whole_pieces(spark):
    docs = spark.createDataFrame([(1, "many words of a long text, é " * 60_000), (2, "x" * 100_000)], "doc_id long, text string")
    rows = packing.packed(docs).collect()
    t = Tokenizer.from_file(PATH)
    for i, text in docs.collect():
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        parts = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["ids_crc32"] for r in parts] == [zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]])) for r in parts]
        assert sum(r["length"] for r in parts) == len(ids)


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (2, None, 5), (None, "c", 5)], "doc_id long, text string, piece int")
    rows = packing.packed(docs).collect()
    assert len(rows) == 4 and {r["doc_id"] for r in rows} == {1, 2, None}
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4
    assert packing.packed(docs.where("false")).count() == 0
    found = packing.place(packing.pieces(docs, PATH))
    one = packing.sequences(found).collect()
    assert len(one) == 1 and len(one[0]["ids"]) == 4 * sum(r["length"] for r in rows)
