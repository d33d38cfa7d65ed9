import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import alignment as module
from ledgerloom.llm.alignment import alignment, byte_level, op13_tokenizer_alignment

A, B = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def spans(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(rows):
    """Whole texts, each token against those that overlap it."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = byte_level()
    assert sorted(byte.values()) == list(range(256))
    spell_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], Counter()
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        x = [(k, spell_a(k)) for k in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        y = [(k, spell_b(k)) for k in b.encode(text)] if text else []
        if not text or any(b"".join(t for _, t in z) != raw for z in (x, y)):
            found.append((i, None))
            continue
        x, y = spans(x), spans(y)
        links, at = [], 0
        for k, s, e in y:
            while x[at][2] <= s:
                at += 1
            for j in range(at, len(x)):
                if x[j][1] >= e:
                    break
                links.append((x[j][0], k))
        ends = sorted({e for _, _, e in x} & {e for _, _, e in y})
        group = lambda z, lo, hi: ",".join(str(k) for k, s, e in z if lo <= s < hi)
        line = ";".join(f"{group(x, lo, hi)}|{group(y, lo, hi)}" for lo, hi in zip([0, *ends], ends)) if len(x) < 3000 else None
        count.update(links)
        found.append((i, (len(x), len(y), len(ends), links, line)))
    best = defaultdict(int)
    for (_, k), n in count.items():
        best[k] = max(best[k], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, line = f
        sums = sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links)
        out.append((i, n_a, n_b, n_groups, len(links), *sums, line and hashlib.sha256(line.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def same(found, want):
    assert len(found) == len(want)
    for x, y in zip(found, want):
        assert x[:7] == y[:7]
        assert y[7] is None or x[7] == y[7]


def test_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    same(got(op13_tokenizer_alignment(spark, folder)), brute(rows))


ODD = [
    None, "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb\n", "a\tb \t c", "x  y", "　 z", "▁", "a▁b", "a ▁ b", "<|endoftext|>",
    "one <|endoftext|> two", "<s> </s> <unk> <0x0A>", "naïve café — “quoted” text", "日本語 の テキスト", "👩‍👩‍👧 emoji ﬁ", "é ̈", "it's we'll I'D", "1234567 89,000.50",
    "a\0b \x1c c", "\r\n line\r\n", "....  ....", "x" * 3000, "ab " * 2000, "  sep", " 　 wide",
]


@pytest.mark.parametrize("block", [1, 60, 16 << 20])
@pytest.mark.parametrize("part", [1, 4 << 20])
def test_odd_texts_in_blocks(spark, monkeypatch, block, part):
    monkeypatch.setattr(module, "PART", part)
    rows = [*enumerate(ODD), (None, "a b"), (3, "a b"), (3, "again a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS kind", "3 AS n_a", "4 AS pair", "5 AS runs")
    want = brute(rows)
    same(got(alignment(docs, A, B, block)), want)
    assert sum(w[7] == "" for w in want) >= 4


def test_random_texts(spark):
    rng = random.Random(4)
    alphabet = ["a", "B", "é", " ", " ", "  ", "\n", ".", ",", "'s", "9", "\t", "ß", "—", "the", " of", "▁", " ", " ", "-"]
    rows = [(k, "".join(rng.choices(alphabet, k=rng.randrange(25)))) for k in range(400)]
    same(got(alignment(spark.createDataFrame(rows, "doc_id long, text string"), A, B)), brute(rows))


def test_without_documents_and_without_texts(spark):
    assert got(alignment(spark.createDataFrame([], "doc_id long, text string"), A, B)) == []
    assert got(alignment(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B)) == [(1, 0, 0, 0, 0, 0, 0, "")]
