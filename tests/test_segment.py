"""Learnt sentence ends against a plain version, and against the rule alone on texts with abbreviations."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql.functions import udf

from ledgerloom.functions import text as texts
from ledgerloom.operators import segment
from ledgerloom.plans.catalog import QUERIES


def kind(t):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    return re.sub(r"""^[("'\[]+|[)"'\],;:]+$""", "", lower)


def bare(k):
    return k[:-1] if k.endswith(".") else k


def together(a, b, ab, n):
    part = lambda k, m, p: (k * math.log(p) if k else 0) + (m * math.log(1 - p) if m else 0)
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    rest = n - a - b + ab
    return -2 * (part(ab, a - ab, p) + part(b - ab, rest, p) - part(ab, a - ab, p1) - part(b - ab, rest, p2))


def brute_model(docs):
    n, stops, seen = Counter(), Counter(), []
    for t in docs:
        ks = [kind(x) for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        for k, x in zip(ks, [*ks[1:], None]):
            n[bare(k)] += 1
            stops[bare(k)] += k.endswith(".")
            seen.append((k, None if x is None else bare(x)))
    total, p = sum(n.values()), sum(stops.values()) / max(1, sum(n.values()))
    abbr = {}
    for w, s in stops.items():
        if s and re.search(r"[^\W\d_]", w) and not re.search("[0-9]", w) and 0 < p < 1:
            free, dots = n[w] - s, w.count(".")
            size = len(w) - dots
            score = 2 * (s * (math.log(0.99) - math.log(p)) + free * (math.log(0.01) - math.log(1 - p))) * math.exp(-size) * (dots + 1) * float(size) ** -free
            if score >= 0.3:
                abbr[w] = score
    starts = Counter(x for k, x in seen if x is not None and (re.search("[!?]$", k) or k.endswith(".") and bare(k) not in abbr))
    breaks = sum(starts.values())
    starters = {w for w, c in starts.items() if re.search(r"[^\W\d_]", w) and c * total > n[w] * breaks and together(breaks, n[w], c, total) >= 30}
    pairs = Counter((bare(k), x) for k, x in seen if x is not None and k.endswith(".") and bare(k) in abbr)
    glued = {(a, b) for (a, b), c in pairs.items() if c > 1 and c * total > n[a] * n[b] and together(n[a], n[b], c, total) >= 7.88}
    return abbr, starters, glued


def brute(t, model):
    abbr, starters, glued = model
    out = []
    for i, p in enumerate(p for x in re.split(r"\n{2,}", t or "") if len(p := x.strip(" ")) >= 10):
        parts = [x.strip(" ") for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])", p)]
        whole = [[x] for x in parts if x][:1]
        for a, b in zip(parts, parts[1:]):
            k, x = kind(a.split()[-1]), bare(kind(b.split()[0]))
            w = bare(k)
            held = k.endswith(".") and (w in abbr or re.fullmatch(r"[^\W\d_]", w)) and (x not in starters or (w, x) in glued)
            whole[-1].append(b) if held else whole.append([b])
        out += [(i, j, " ".join(x)) for j, x in enumerate(whole) if len(" ".join(x).split()) >= 3]
    return out


def invented(seed, n=160):
    """Texts of known sentences with titles before names, and the places of their ends."""
    rng = random.Random(seed)
    words = [a + b for a in ("ba", "ko", "mi", "tu", "ze") for b in ("lan", "rit", "sof", "num", "dek", "pal")]
    names, titles, opening = [w.capitalize() for w in words[:12]], ["Dr.", "Inc.", "e.g.", "approx."], ["The", "This", "However"]
    docs = []
    for _ in range(n):
        said = []
        for _ in range(rng.randrange(2, 7)):
            s = [rng.choice(opening) if rng.random() < 0.7 else rng.choice(words).capitalize()] + rng.choices(words, k=rng.randrange(4, 9))
            if rng.random() < 0.6:
                at = rng.randrange(1, len(s))
                s[at:at] = [rng.choice(titles), rng.choice(names) if rng.random() < 0.8 else rng.choice(words)]
            said.append(" ".join(s) + ".")
        docs.append(said)
    return docs


def test_against_a_plain_version(spark):
    docs = [" ".join(d) for d in invented(1)] + [None, "", "One. Two", "no stops here at all", "A. B. Cee dee. Ee (Dr.) Eff! Gee? Hah hah hah", "x\n\nNew para here. J. Smith said so. The end is here"]
    df = spark.createDataFrame([(k % 150, t) for k, t in enumerate(docs)], "k int, t string").selectExpr("*", "1 AS word", "2 AS row", "3 AS key", "4 AS part")
    model = segment.learn(df, "t")
    abbr, starters, glued = want = brute_model(docs)
    got = {r["word"]: r["score"] for r in model["abbreviations"].collect()}
    assert set(got) == set(abbr) and all(math.isclose(got[w], abbr[w], rel_tol=1e-9) for w in abbr) and {"dr", "inc", "e.g", "approx"} <= set(abbr)
    assert {r["word"] for r in model["starters"].collect()} == starters >= {"the", "this", "however"}
    assert {(r["word"], r["next"]) for r in model["collocations"].collect()} == glued
    found = sorted((r["k"], r["paragraph_index"], r["sentence_index"], r["text"]) for r in segment.sentences(df, "k", "t", model).collect())
    assert found == sorted((k % 150, *s) for k, t in enumerate(docs) for s in brute(t, want))


def test_better_than_the_rule_alone(spark):
    docs = invented(2, 300)
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "k int, t string")
    truth = {(k, s) for k, d in enumerate(docs) for s in d}

    def f1(rows):
        got = {(r["k"], r["text"]) for r in rows.collect()}
        return 2 * len(got & truth) / (len(got) + len(truth))

    learnt, rule = f1(segment.sentences(df, "k", "t", segment.learn(df, "t"))), f1(texts.sentences(df, "k", "t"))
    assert learnt > 0.95 and learnt > rule + 0.2


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, None), (2, "no end to this")], "k int, t string")
    model = segment.learn(df, "t")
    assert all(t.count() == 0 for t in model.values())
    assert [r["text"] for r in segment.sentences(df, "k", "t", model).collect()] == ["no end to this"]
    assert segment.sentences(df.where("false"), "k", "t", segment.learn(df.where("false"), "t")).count() == 0


def test_query_against_a_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    docs = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        t = r["text"]
        for word, short in (("the", "Corp."), ("der", "z.B."), ("les", "env."), ("los", "Sr.")):
            t = t.replace(f" {word} ", f" {short} ")
        docs[r["doc_id"]] = t
    model = brute_model(docs.values())
    found = defaultdict(list)
    for r in QUERIES["learnt_sentences"](spark, folder).orderBy("paragraph_index", "sentence_index").collect():
        found[r["doc_id"]].append((r["paragraph_index"], r["sentence_index"], r["text"]))
    assert {k: v for k, t in docs.items() if (v := brute(t, model))} == found and "corp" in model[0]


def test_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def told(t):
        read.add(1)
        return t

    docs = ["Sales of Acme Corp. grew. The end came! No. 5 of env. 3?", None, "", 'He said "no." Then (he) left, z.B. here. "']
    df = spark.createDataFrame([(t,) for t in docs], "t string").coalesce(1)
    model = segment.learn(df.select(udf(told, "string")("t").alias("t")), "t")
    assert read.value == len(docs)
    got = {(r["word"], r["stop"], r["mark"], r["next"]): r["n"] for r in segment.occurrences(df, "t").collect()}
    assert sum(got.values()) == sum(len((t or "").split()) for t in docs) and got["", False, False, None] == 1
    assert got["corp", True, False, "grew"] == 1 and got["the", False, False, None] == 1 and got["no", True, False, "5"] == 1
    assert set(model) == {"abbreviations", "starters", "collocations"}


def test_paragraphs_stay_in_their_row(spark, monkeypatch):
    staged, put = [], segment.stage
    docs = [" ".join(d) for d in invented(3, 60)] + ["\tDr.\nMi said\tno.\n The\tco Inc.\x0b Ba left (Dr. Ko).  So e.g.\r\n\nThe Dr. Pal. A.\tB. Ends. here", "\n. One two three. \n\n\n Is it? Dr.  However Mi is it! "]
    df = spark.createDataFrame(list(enumerate(docs)), "k int, t string")
    model = segment.learn(df, "t")
    monkeypatch.setattr(segment, "stage", lambda rows, tag: staged.append(tag) or put(rows, tag))
    found = segment.sentences(df, "k", "t", model)
    assert len(staged) == 1 and "Window" not in found.drop("seq")._jdf.queryExecution().optimizedPlan().toString()
    want = brute_model(docs)
    rows = sorted((r["k"], r["seq"], r["paragraph_index"], r["sentence_index"], r["text"]) for r in found.collect())
    assert rows == [(k, n, *s) for k, t in enumerate(docs) for n, s in enumerate(brute(t, want))]
