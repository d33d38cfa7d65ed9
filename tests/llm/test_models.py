"""Classifiers: held-out accuracy, kernels against brute force, and defined results at the edges."""

import itertools
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ledgerloom.llm import language, quality, toxicity

SF = "/root/testdata/sf0.1"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.op4_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.995
    assert sum(r["rejected"] for r in rows) < 0.005 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.withColumn("h", docs["doc_id"]), 300)
    long = "Der ungheit die schlich und " * 60_000
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 *** 7"), (4, long), (4, long), (None, "the and of that")], "doc_id long, text string")
    got = sorted(map(tuple, language.identified(odd.selectExpr("*", "'fr' AS lang", "1 AS score"), model).drop("held_out").collect()), key=str)
    assert [r[1] for r in got] == ["und", "und", "und", "de", "de", "en"]
    assert [r[3] for r in got] == [True] * 3 + [False] * 3 and got[0][2] == 0
    one, many = model.predict([long])[1], model.predict(["x", long, "y"])[1]
    assert math.isclose(one[0], many[1])
    none = language.train(docs.where("false"))
    assert {r["lang_pred"] for r in language.identified(odd, none).collect()} == {"und"}
    assert language.identified(odd.where("false"), model).count() == 0


def test_language_chunks_add_up(monkeypatch):
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b"], rng.normal(size=(language.BUCKETS, 2)).astype("f4"), np.zeros(2, "f4"), 0.0)
    texts = ["ab cd " * n for n in (1, 50, 3)] + [None, "é"]
    want = model.predict(texts)[1]
    for text, score in zip(texts, want):
        if text:
            i, share = language.bag(text)
            assert math.isclose(language.softmax((share @ model.logits[i]).astype(float)).max(), score, rel_tol=1e-4)
    monkeypatch.setattr(language, "CHUNK", 16)
    assert np.allclose(model.predict(texts)[1], want, atol=1e-5)


def brute_measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeat = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeat)


ODD = [None, "", " \n\t", "a b c a b c", "a a a a", "x  y\n\nx  y\n x  y\r\n#|", "é é é é\x0bñ\x85z", "one"]


def test_quality_measures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(150)
    for text in ODD + [r["text"][:6000] for r in docs.collect()]:
        assert quality.measure(text)[:5] == brute_measure(text), text


@pytest.mark.parametrize("n", [0, 1, 7, 60, 400])
def test_exact_binomial_bound(n):
    p, level, total, want = Fraction(1, 20), Fraction(1, 25), Fraction(0), -1
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total > level:
            break
        want = k
    assert quality.most_failures(n, 0.05, 0.04) == want


def test_quality_query_against_brute_force(spark):
    """All columns of the query over whole texts; cutoffs by counting trials for each cutoff in turn."""
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        marks[r["doc_id"]] = min(r["quality"], marks.get(r["doc_id"], 1))
    measured = {i: (brute_measure(r["text"]) if len(r["text"] or "") < 20_000 else quality.measure(r["text"])[:5], max(quality.measure(r["text"])[5:])) for i, r in docs.items()}
    failed = {i: m[0] < 50 or 100 * m[4] > 50 * m[0] for i, (m, _) in measured.items()}
    trials = {}
    for i in marks.keys() & docs.keys():
        if not failed[i]:
            key = docs[i]["lang"], docs[i]["text"]
            trials[key] = min(marks[i], trials.get(key, (1, 0))[0]), measured[i][1]
    strata, cutoff = {k[0] for k in trials}, {}
    for s in strata:
        good, bad = ([b for k, (q, b) in trials.items() if k[0] == s and q == want] for want in (1, 0))
        most = quality.most_failures(len(good), quality.LIMIT, quality.LEVEL / len(strata))
        gains = {c: sum(b >= c for b in bad) - 20 * lost for c in range(1, 1001) if (lost := sum(b >= c for b in good)) <= most}
        best = max(gains.values(), default=0)
        cutoff[s] = max(c for c, g in gains.items() if g == best) if best > 0 else 1001
    got = quality.op5_risk_controlled_rules(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        m, badness = measured[r["doc_id"]]
        assert tuple(r)[1:6] == m and r["base_failed"] == failed[r["doc_id"]]
        assert r["kept"] == (not failed[r["doc_id"]] and badness < cutoff.get(docs[r["doc_id"]]["lang"], 1001)), r["doc_id"]


def test_copies_are_no_trials_of_their_own(spark):
    """Three thousand copies of one good text can't prove a cutoff that a single one can't."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text, "aa") for i in range(3000)] + [(10_000 + i, f"{text} {'# ' * 30}{i}", "aa") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 10_000)) for i, _, _ in rows], "doc_id long, quality int")
    assert all(r["kept"] for r in quality.judged(docs, labels).collect())
    varied = docs.selectExpr("doc_id", "concat(text, ' ', doc_id) AS text", "lang")
    assert quality.judged(varied, labels).where("NOT kept").count() == 30


def test_false_rejections_stay_within_the_limit():
    """Over many holdouts the chosen cutoff exceeds the limit no oftener than the level says."""
    rng, over = np.random.default_rng(1), 0
    for _ in range(300):
        good = np.sort(rng.integers(0, 1000, 400))
        most = quality.most_failures(len(good), quality.LIMIT, quality.LEVEL)
        cut = good[-most - 1] + 1 if most >= 0 else 1001
        over += (1000 - cut) / 1000 > quality.LIMIT
    assert over <= 300 * quality.LEVEL + 10


def test_strata_named_none_and_null_are_two(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "none"), (2, text, None)], "doc_id long, text string, lang string")
    assert {r[0] for r in quality.features(docs, "lang").select("stratum").collect()} == {"=none", "null"}


def test_quality_verdicts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.op5_risk_controlled_rules(spark, SF).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) < 0.2 * len(bad)


def test_quality_edges(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} {i}", "aa") for i in range(400)] + [(1000 + i, f"{text} # # # # # # # # # # # # # # # # # # # # # # # # {i}", "aa") for i in range(40)]
    rows += [(5000, "short", "aa"), (5001, None, "bb"), (None, text, None), (5002, "# " * 60, "bb"), (5002, "# " * 60, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS quality", "2 AS stratum", "3 AS cutoff")
    labels = spark.createDataFrame([(i, 1) for i in range(400)] + [(1000 + i, 0) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(400)) and not any(kept[1000 + i] for i in range(40))
    assert not kept[5000] and not kept[5001] and kept[None] and not kept[5002]
    assert all(r["kept"] != r["base_failed"] for r in quality.judged(docs, labels.where("false")).collect())
    assert quality.judged(docs.where("false"), labels).count() == 0


def brute_kernel(s, t):
    def weights(x):
        out = {}
        for i, j, k in itertools.combinations(range(len(x)), 3):
            if k - i <= toxicity.SPAN:
                out[x[i], x[j], x[k]] = out.get((x[i], x[j], x[k]), 0) + toxicity.DECAY ** (k - i - 2)
        return out

    a, b = weights(s), weights(t)
    # a word's norm counts each occurrence, as the operator's does
    norm = math.sqrt(sum(toxicity.DECAY ** (2 * (k - i - 2)) for i, j, k in itertools.combinations(range(len(s)), 3) if k - i <= toxicity.SPAN))
    return sum(a[x] * b[x] for x in a.keys() & b.keys()) / norm / math.sqrt(sum(v * v for v in b.values()))


def test_kernel_against_brute_force():
    words, marks = [b"moron", b"idxiot", b"closer", b"wortthless", "réeuxpa".encode()], [b"moron", b"idiot", b"loser"]
    got = toxicity.Kernel(marks).values(words)
    for w, row in zip(words, got):
        for m, v in zip(marks, row):
            assert math.isclose(v, min(1, max(brute_kernel(w[:n], m) for n in range(4, len(w) + 1))), abs_tol=0.02)


def test_toxicity_held_out_and_spellings(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs.selectExpr("*", "1 AS score"), model).join(labels, "doc_id").where("held_out").collect()
    pairs = [(r["score"], r["toxic"]) for r in rows]
    pos, neg = ([s for s, t in pairs if t == x] for x in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.93 and sum((s >= 0.5) == t for s, t in pairs) > 0.93 * len(pairs)
    insults = ["idiot", "i-d-i-o-t", "i d i o t", "idxiot", "iddiot", "IDIOT!!"]
    assert (model.score([toxicity.word_set(f"you are an {x} , so") for x in insults]) > 0.5).all()
    assert model.score([toxicity.word_set(x) for x in (None, "", "a fine day")]).max() < 0.5
    odd = spark.createDataFrame([(1, None), (None, "x"), (2, "idiot " * 99_999), (2, "idiot " * 99_999)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["predicted"]) for r in toxicity.scored(odd, model).collect()) == [("1", 0), ("2", 1), ("2", 1), ("None", 0)]
    none = toxicity.train(docs, labels.where("false"))
    assert toxicity.scored(odd, none).where("predicted = 1").count() == 0
    assert toxicity.scored(odd.where("false"), model).count() == 0
