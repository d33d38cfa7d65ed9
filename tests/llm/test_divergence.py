import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from ledgerloom.llm import divergence as module
from ledgerloom.llm.divergence import OP12_SQL, divergence, op12_source_divergence


def brute(rows, least=10, ranks=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        prob = lambda n: {t: 1 + 10**9 * (n[t] + 2) // (sum(n[t] for t in kept) + 2 * len(kept)) for t in kept}
        q = prob(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: prob(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[: None if part == "pair" else ranks], 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def invented(seed, n=300):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ab", "É", "zu", "Ω") for b in ("x", "yy", "ç", "Q", "R", "s")]
    rows = []
    for _ in range(n):
        source, lang = rng.choice("abcde"), rng.choice(["l", "m"])
        own = words[ord(source) % 5 :: 2] if rng.random() < 0.5 else words
        rows.append((" ".join(rng.choices(own, [1 / (k + 1) for k in range(len(own))], k=rng.randrange(12))), lang, source))
    return rows


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_against_sql_and_brute_force(spark, folder):
    found = got(op12_source_divergence(spark, folder))
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang", "source").collect()]
    assert found == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    assert found == sorted(con.execute(OP12_SQL).fetchall())


@pytest.mark.parametrize("held", [3, 400_000])
@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_parts_and_limits_change_nothing(spark, monkeypatch, held, broadcast):
    monkeypatch.setattr(module, "HELD", held)
    monkeypatch.setattr(module, "ROWS", 7)
    monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast)
    rows = invented(held)
    assert got(divergence(frame(spark, rows), 4, 3)) == brute(rows, 4, 3)


def test_buckets_below_the_bound_are_left_and_ties_kept(spark):
    rows = [(" ".join(f"w{chr(97 + k)}" for k in range(20)), "l", "a")] * 10 + [("wa " * k + "other", "l", "b") for k in range(12)]
    assert got(divergence(frame(spark, rows), 10, 5)) == brute(rows, 10, 5)


def test_nulls_empty_texts_long_texts_repeats_and_extra_columns(spark):
    rows = [(None, None, None), ("", "", "a"), ("12 .-", "l", "b"), (None, "l", "c"), ("Ab", "only", "one"), *[("ab AB ab", "l", "c")] * 12, ("cd " * 50_000, "l", "b")]
    rows += invented(5, 80) + [("É" * 20_000, "l", None)]
    docs = frame(spark, rows).selectExpr("*", "1 AS term", "2 AS n", "3 AS docs", "4 AS g", "5 AS t", "6 AS p", "7 AS value", "8 AS item", "9 AS doc_id")
    assert got(divergence(docs)) == brute(rows)


def test_without_documents_and_without_terms(spark):
    assert got(divergence(frame(spark, []))) == []
    assert got(divergence(frame(spark, [("x", "l", "a"), ("y", "l", "b")]))) == [("l", "a", "pair", "b", 0, 1), ("l", "b", "pair", "a", 0, 1)]
