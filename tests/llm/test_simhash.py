import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.simhash import codewords, fingerprint, keys, links, near_duplicates, op11_golay_simhash


def brute_print(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            root[find(j)] = find(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    return sorted([(i, f"{p:016x}", least[find(k)]) for k, ((i, _), p) in enumerate(zip(rows, prints))], key=str)


def test_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sorted(map(tuple, op11_golay_simhash(spark, folder).collect()), key=str) == want
    assert any(i != c for i, _, c in want)


def test_words_have_one_codeword_or_six_and_near_words_share_one():
    rng = np.random.default_rng(1)
    words = rng.integers(1 << 23, size=300)
    number, ok = codewords(words)
    assert set(ok.sum(axis=1)) == {1, 6}
    for w, n, k in zip(words, number, ok):
        for flipped in ([], *([b] for b in range(23)), *itertools.combinations(range(23), 2)):
            other = int(w) ^ sum(1 << b for b in flipped)
            m, l = codewords(np.array([other]))
            assert set(n[k]) & set(m[0][l[0]])


def test_prints_within_two_bits_share_a_key():
    rng = random.Random(2)
    for _ in range(30):
        a = rng.getrandbits(64)
        for bits in ([], [5], [63], *(rng.sample(range(64), 2) for _ in range(40))):
            b = a ^ sum(1 << k for k in bits)
            at, key = keys(np.array([a, b], np.uint64))
            assert set(key[at == 0].tolist()) & set(key[at == 1].tolist())


@pytest.mark.parametrize("crowd", [1, 3, 256])
def test_links_of_crowds_are_whole(spark, crowd):
    rng, prints = random.Random(3), set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    signed = sorted(p - (p >> 63 << 64) for p in prints)
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    found = [tuple(r) for r in links(spark.createDataFrame([(p,) for p in signed], "print long"), crowd).collect()]
    assert len(found) == len(set(found)) and set(found) == want and want


def test_nulls_ties_repeats_long_texts_and_extra_columns(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TOGETHER", 1000)
    long = " ".join(f"w{k % 700}x{k // 9}" for k in range(20_000))
    texts = [None, "", " \n\t", "One TWO", "one two", "ÉCLAIR", "éclair", "x " * 5000, long, long + " end", "a b c", "a b c d"]
    rows = [*enumerate(texts), (None, "one two"), (None, "alone here"), (3, "one two"), (3, "other words than before")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS print", "2 AS key", "3 AS low", "4 AS node", "5 AS comp")
    found = near_duplicates(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
    assert fingerprint(long) == brute_print(long)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
