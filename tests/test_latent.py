"""Learnt embeddings against numpy's decomposition of the whole matrix."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.operators import latent, vectors
from ledgerloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def matrix(texts):
    """Ids, words and rows of length 1 as the operator weighs them."""
    counts = {i: Counter(re.findall(r"[^\W_]+", t.lower())) for i, t in texts if t}
    df = Counter(w for c in counts.values() for w in c)
    n, words = sum(bool(c) for c in counts.values()), sorted(w for w, k in df.items() if k >= 2)
    at = {w: j for j, w in enumerate(words)}
    ids, rows = [], []
    for i, c in counts.items():
        row = np.zeros(len(words))
        for w in c:
            if w in at:
                row[at[w]] = (1 + np.log(c[w])) * (np.log((1 + n) / (1 + df[w])) + 1)
        if row.any():
            ids.append(i)
            rows.append(row / np.linalg.norm(row))
    return ids, words, np.array(rows)


def invented(n=40):
    rng = np.random.default_rng(3)
    topics = [["loan", "bank", "rate", "credit"], ["chip", "wafer", "fab", "node"], ["drug", "trial", "dose", "cell"]]
    return [(k, " ".join(rng.choice(topics[k % 3], 6)) + " and the" * (k % 4)) for k in range(n)]


@pytest.mark.parametrize("most", [200_000, 0])
def test_space_is_that_of_the_whole_matrix(spark, monkeypatch, most):
    monkeypatch.setattr(latent, "BROADCAST_TERMS", most)
    monkeypatch.setattr(latent, "FAN", 2)
    texts = [*invented(), (90, None), (91, ""), (92, "lonely"), (None, "bank")]
    df = spark.createDataFrame(texts, "term long, w string").selectExpr("*", "1 AS id", "2 AS v").repartition(5)
    held = latent.space(df, "term", "w", 5)
    ids, _, a = matrix(texts[:-1])
    _, s, right = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(held.strengths, s[:5], rtol=1e-6)
    got = {r[0]: r[1] for r in held.embed(df, "term", "w").collect()}
    assert sorted(got) == sorted(ids)
    x, want = np.array([got[i] for i in ids]), a @ right[:5].T
    assert np.allclose(x @ x.T, want @ want.T, atol=1e-6)


@pytest.mark.parametrize("most", [0, 6, 11])
def test_terms_of_few_texts_are_joined_and_the_others_sent(spark, monkeypatch, most):
    monkeypatch.setattr(latent, "BROADCAST_TERMS", most)
    monkeypatch.setattr(latent, "WORDS", 3 * most)
    monkeypatch.setattr(latent, "PART", 16)
    texts = invented(60)
    df = spark.createDataFrame(texts, "term long, w string").repartition(4)
    held = latent.space(df, "term", "w", 5)
    _, _, a = matrix(texts)
    _, s, right = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(held.strengths, s[:5], rtol=1e-6)
    got = {r[0]: r[1] for r in held.embed(df, "term", "w").collect()}
    x, want = np.array([got[i] for i, _ in texts]), a @ right[:5].T
    assert np.allclose(x @ x.T, want @ want.T, atol=1e-6)


def test_rank_and_emptiness(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, "a b")], "k long, t string")
    assert np.allclose(latent.space(df, "k", "t", 4).strengths, [3**0.5])
    for none in (df.where("false"), df.selectExpr("k", "CAST(NULL AS string) AS t")):
        held = latent.space(none, "k", "t", 4)
        assert len(held.strengths) == 0 and held.embed(df, "k", "t").count() == 0


def test_lookup_finds_entries_of_the_same_subject(spark):
    entries = spark.createDataFrame([(f"e{k}", t) for k, t in invented()], "term string, entry string")
    asked = spark.createDataFrame([(1, "credit bank"), (2, "Wafer node, chip"), (3, "unheard of")], "q long, t string")
    got = latent.lookup(latent.space(entries, "term", "entry", 3), entries, "term", "entry", asked, "q", "t").collect()
    assert {(r["q"], int(r["term"][1:]) % 3) for r in got} == {(1, 0), (2, 1)} and len(got) == 10
    assert sorted(r["rank"] for r in got) == sorted([*range(1, 6)] * 2)


def test_queries_over_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids, _, a = matrix([(r["doc_id"], r["text"]) for r in docs])
    at = {i: k for k, i in enumerate(ids)}
    got = QUERIES["latent_topk"](spark, SF).collect()
    asked = [i for i in ids if i % 20 == 0]
    assert len(got) == 10 * len(asked) and {r["query"] for r in got} == set(asked)
    # what is near in the space has more words in common than others have
    near = np.mean([a[at[r["query"]]] @ a[at[r["doc_id"]]] for r in got if r["query"] != r["doc_id"]])
    assert near > 1.5 * np.mean(a @ a.T)
    assert sum(r["score"] >= 0.999 for r in got if r["query"] == r["doc_id"]) == len(asked)


def test_glossary_lookup(spark):
    got = QUERIES["glossary_lookup"](spark, SF).collect()
    assert got and all(-1.001 <= r["score"] <= 1.001 and 1 <= r["rank"] <= 5 and r["doc_id"] % 20 == 0 for r in got)
    assert max(Counter(r["doc_id"] for r in got).values()) <= 5


@pytest.mark.parametrize("few", [0, 8, 10**6])
def test_search_ranks_few_scores_by_themselves(spark, monkeypatch, few):
    monkeypatch.setattr(vectors, "FEW", few)
    rng = np.random.default_rng(4)
    m = rng.integers(-2, 3, (3000, 3)).astype(float)  # many ties, some without length
    rows = [(k, None if k % 50 == 3 else v) for k, v in enumerate(m.tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    got = {}
    for r in vectors.search(df, df.where("id % 20 = 0"), "id", "v", 7).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["score"]))
    length = np.linalg.norm(m, axis=1)
    ok = [k for k, v in rows if v and length[k]]
    unit = vectors.unit(pa.array([v for _, v in rows], pa.list_(pa.float64())), 3)
    for q in (k for k in ok if k % 20 == 0):
        s = unit[[q]] @ unit.T
        scores = [round(float(x), 3) for _, x in got[q]]
        assert len(scores) == 7 and np.allclose(scores, sorted((float(s[0, k]) for k in ok), reverse=True)[:7], atol=1e-3)
    assert set(got) == {k for k in ok if k % 20 == 0} and not {k for v in got.values() for k, _ in v} - set(ok)
    # a later block's few hits change their rows alone, ties by id
    s, n = np.array([[3.0, 1.0], [2.0, -np.inf]]), np.array([[5, 9], [4, 0]])
    vectors._ranked(s, n, np.array([0, 0, 1]), np.array([1.0, 3.0, 2.0]), np.array([2, 6, 1]))
    assert s.tolist() == [[3.0, 3.0], [2.0, 2.0]] and n.tolist() == [[5, 6], [1, 4]]
