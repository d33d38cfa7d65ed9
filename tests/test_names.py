"""Names by the automaton against a join of all runs, and the tagger against all label sequences."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa

from ledgerloom import jobs
from ledgerloom.operators import entities, names
from ledgerloom.plans.catalog import QUERIES

KNOWN = [("Tyson Foods", "ORG"), ("Germany", "GPE"), ("tyson", "GPE"), ("A.B. Corp.", "ORG"), ("Foods Inc", "ORG"), ("Éclat", "ORG"), ("New York City Hall Bar", "LOC"), ("one two three four five six", "ORG"), ("(odd", "ORG"), ("U.S.", "GPE"), ("Germany", "LOC"), (None, "ORG"), ("", "ORG")]
TEXTS = [
    "We met Tyson Foods, Inc. in Germany.", "tyson foods and GERMANY (Germany)!", "Tyson  Foods\tInc", "A.B. Corp. v. “A.B. Corp”", "ÉCLAT éclat Éclat.", "In New York City Hall Bar, we", "One two three four five six",
    "TysonFoods Tyson-Foods xTyson Tyson", "(odd Odd (Odd", "U.S. U.S., the U.S.)", None, "", "   ", "Germany Germany",
]


def test_automaton_is_the_join(spark):
    rng = random.Random(1)
    vocabulary = [w for t in TEXTS if t for w in t.split(" ")] + ["and", "The", "--", "Foods"]
    texts = TEXTS + [" ".join(rng.choices(vocabulary, k=rng.randrange(14))) for _ in range(150)]
    s = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "k int, text string, kept string")
    gazetteer = spark.createDataFrame(KNOWN, "name string, label string")
    rows = lambda df: sorted(map(tuple, df.select("k", "kept", "at", "name", "label").distinct().collect()))
    found, joined = rows(entities.named(s, gazetteer)), rows(entities.joined(s, gazetteer.where("name <> ''")))
    assert found == joined and {"Tyson Foods", "A.B. Corp.", "New York City Hall Bar", "U.S."} <= {r[3] for r in found}


def test_larger_gazetteers_are_joined(spark, monkeypatch):
    monkeypatch.setattr(names, "AUTOMATON_NAMES", 2)
    s = spark.createDataFrame([(1, "In Germany")], "k int, text string")
    assert [tuple(r) for r in entities.named(s, spark.createDataFrame(KNOWN[:3], "name string, label string")).collect()] == [(1, 2, "Germany", "GPE")]


def test_best_labels_are_the_best_of_all():
    rng = np.random.default_rng(2)
    labels = ["O", "B-GPE", "I-GPE", "B-ORG", "I-ORG"]
    steps = names.steps_of(labels) + rng.normal(size=(6, 5))
    tagger = names.Tagger(labels, rng.normal(size=(names.PLACES, 5)), steps)
    texts = [[f"w{rng.integers(9)}" for _ in range(n)] for n in (1, 2, 3, 4, 5, 5, 1, 0)]
    for words, got in zip(texts, tagger.best(texts)):
        if not words:
            assert got == []
            continue
        e = tagger.emissions(words)
        total = lambda tags: steps[-1, tags[0]] + sum(e[t, k] for t, k in enumerate(tags)) + sum(steps[a, b] for a, b in zip(tags, tags[1:]))
        best = max(itertools.product(range(5), repeat=len(words)), key=total)
        assert got == list(best) and np.isfinite(total(best))


def invented(seed, firsts, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        org, place = f"{rng.choice(firsts)} {rng.choice(['Corp', 'Foods', 'Group'])}", rng.choice(firsts)
        out.append(rng.choice([f"We compete with {org} here.", f"Sales in {place} rose again.", f"Our rivals such as {org} and others grew.", f"The plant in {place} was sold to {org} last year.", "However, costs rose and margins fell."]))
    return out


def f1(got, want):
    return 2 * len(got & want) / (len(got) + len(want))


def test_names_that_the_gazetteer_lacks(spark):
    firsts = ["".join(x) for x in itertools.product(["Bar", "Kel", "Mon", "Tri", "Zan"], ["dok", "lim", "sor", "wen"], ["a", "ex", "io"])]
    known, unknown = firsts[::2], firsts[1::2]
    gazetteer = spark.createDataFrame([(f"{w} {k}", "ORG") for w in known for k in ("Corp", "Foods", "Group")] + [(w, "GPE") for w in known], "name string, label string")
    lines = lambda texts: spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    tagger = names.learn(lines(invented(3, known, 600)), gazetteer)
    texts = invented(4, unknown, 300)
    want = set()
    for k, t in enumerate(texts):
        words = t.split()
        want |= {(k, i + 1, f"{words[i]} {names.cleaned([words[i + 1]])}", "ORG") for i in range(len(words) - 1) if words[i] in unknown and names.cleaned([words[i + 1]]) in ("Corp", "Foods", "Group")}
        want |= {(k, i + 1, w, "GPE") for i, w in enumerate(words) if w in unknown and words[i - 1] == "in"}
    got = {tuple(r) for r in names.by_tagger(lines(texts), tagger).select("k", "at", "name", "label").collect()}
    assert f1(got, want) > 0.95
    assert names.by_tagger(lines([None, "", " "]), tagger).count() == 0
    docs = jobs.learnt_extractor  # an extractor like that of the gazetteer
    assert callable(docs(gazetteer))


def test_nothing_to_learn_from(spark):
    s = spark.createDataFrame([(1, "Some words")], "k int, text string")
    none = spark.createDataFrame([], "name string, label string")
    assert names.by_tagger(s, names.learn(s.where("false"), none)).count() == 0 and entities.named(s, none).count() == 0


def test_query_on_held_out_documents(spark):
    rows = [r for r in QUERIES["learnt_names"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    learnt, marked, both = (sum(r[c] for r in rows) for c in ("learnt", "marked", "both"))
    assert marked > 20 and 2 * both / (learnt + marked) > 0.9


def test_batches_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(names, "HELD", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["abcd", None, "efgh", "x" * 25, "", "y", "z" * 9])], names=["k", "text"])
    cut = names.parts(batch)
    assert [p.column(0).to_pylist() for p in cut] == [[0, 1, 2], [3, 4, 5], [6]] and pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))
    assert names.parts(batch.slice(0, 0)) == []


def test_sentences_one_by_one_and_together_get_the_same_labels():
    rng = random.Random(3)
    labels = ["O", "B-GPE", "I-GPE", "B-ORG", "I-ORG"]
    steps = names.steps_of(labels)
    # whole numbers, so that scores are often equal
    weights = np.array([[rng.randrange(-2, 3) for _ in labels] for _ in range(names.PLACES)], float)
    tagger = names.Tagger(labels, weights, steps)
    texts = [[rng.choice(["Acme", "of", "Rome", "x1", "Ünder", "ABC"]) for _ in range(rng.randrange(12))] for _ in range(3 * names.FEW)]
    together = tagger.best(texts)
    assert together == [tagger.best([t])[0] for t in texts] and len({len(t) for t in texts}) > 5
    for said in ("a\x1cb c\x85d e f  g\x0bh", "", None, " \n", "x\n\ty"):
        assert names.words_of(said) == [w for w in re.split("[ \t\n\x0b\f\r]+", said or "") if w]
    assert [names.shape(w) for w in ("abc", "Abc", "ABC", "A", "aBc", "Åb", "x-1", "A.B.")] == ["x", "Xx", "X", "X", "xXx", "Xx", "x-d", "X.X."]


def test_a_long_sentence_is_not_tagged_word_by_word_with_arrays(monkeypatch):
    tagger = names.Tagger(["O", "B-ORG", "I-ORG"], np.zeros((names.PLACES, 3)), names.steps_of(["O", "B-ORG", "I-ORG"]))
    calls = []
    monkeypatch.setattr(names, "features", lambda words, f=names.features: calls.append(len(words)) or f(words))
    assert tagger.best([["a", "b"] * 5000]) == [[0] * 10000]
    assert calls == [3]
