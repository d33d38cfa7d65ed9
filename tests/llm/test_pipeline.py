import zlib
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import language, quality
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_winnowing import brute as brute_hits

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = language.train(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out, now = [], docs
    for name, f in corpus_pipeline.STAGES:
        now = f(spark, now, SF).cache()
        out.append((name, now))
        assert now.columns == docs.columns or name == "best_fit_packing"
    kept = [{r["doc_id"] for r in x.select("doc_id").collect()} for _, x in out]
    named = {i for i, t in texts.items() if not model.predict([t])[2][0]}
    assert kept[0] == named
    judged = quality.judged(docs.where(docs.doc_id.isin(list(named))), spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept[1] == {r["doc_id"] for r in judged.collect() if r["kept"]}
    assert kept[2] == {i for i, g in brute_groups([(i, texts[i]) for i in kept[1]], 80).items() if g[2]}
    assert kept[3] == {r[0] for r in brute_hits([(i, texts[i]) for i in kept[2]], items) if not r[5]}
    pieces = defaultdict(list)
    for r in out[4][1].collect():
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == kept[3] and len(kept[3]) < len(texts)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, parts in pieces.items():
        assert sum(r["length"] for r in parts) == len(t.encode(texts[i], add_special_tokens=False).ids) + 1


def test_clean_documents_stay_and_run_is_the_stages(spark):
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()
    held = [r["doc_id"] for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(ids & set(held)) > 0.5 * len(held)


def test_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.where("n_chars > 2000 AND lang = 'en'").limit(1).collect()[0]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, long["text"], "en", "a", 1), (2, long["text"], "en", "a", 1), (3, long["text"], None, "b", 1)], docs.schema)
    for rows in (docs.where("false"), odd):
        now = rows
        for name, f in corpus_pipeline.STAGES:
            now = f(spark, now, SF).cache()
            assert (name == "best_fit_packing") or now.columns == docs.columns
            if name == "near_dedup":
                assert now.count() <= 1


def test_clashing_columns_stay_as_they_are(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = ["_row", "_Row_", "quality", "of", "key", "place", "row", "component_id", "kept", "stratum", "rejected", "n", "count", "contaminated", "node"]
    plain, clashing = docs, docs.selectExpr("*", *(f"'{c}' AS `{c}`" for c in names))
    repeated = clashing.union(clashing.where("doc_id % 7 = 0"))
    for name, f in corpus_pipeline.STAGES[:4]:
        plain, clashing, repeated = f(spark, plain, SF), f(spark, clashing, SF), f(spark, repeated, SF)
        assert clashing.columns == repeated.columns == [*docs.columns, *names]
        assert sorted(r[0] for r in clashing.select("doc_id").collect()) == sorted(r[0] for r in plain.select("doc_id").collect())
        assert [tuple(r) for r in clashing.select(*names).distinct().collect()] == [tuple(names)]
    assert plain.count() and {r[0] for r in repeated.select("doc_id").collect()} >= {r[0] for r in plain.where("doc_id % 7 <> 0").select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[4][1](spark, clashing, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in plain.select("doc_id").collect()}
