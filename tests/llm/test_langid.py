from zlib import crc32

import pytest

from agentcorpus.llm import langid
from agentcorpus.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf):
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op9_language_id"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(known)
    for r in rows:
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in held) >= 0.97 * len(held)


@pytest.fixture(scope="module")
def model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return langid.fit(docs)


def test_counts_equal_plain_counting(spark):
    rows = [(1, "Ab, c", "x"), (2, "ab", "x"), (3, "zz", "y"), (4, None, "x"), (5, "no", None)]
    counts = langid.count_grams(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    total = {}
    for r in counts:
        if r["bucket"] >= 0:
            total[r["lang"]] = total.get(r["lang"], 0) + r["n"]
    # " ab c " has 3 letters, 5 pairs, 4 triples; " ab " has 2, 3, 2; " zz " the same
    assert total == {"x": 12 + 7, "y": 7}
    assert {(r["lang"], r["n"]) for r in counts if r["bucket"] == -1} == {("x", 2), ("y", 1)}


def test_batches_do_not_matter(model, spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    together = model.predict(texts)
    alone = [model.predict([t]).iloc[0].tolist() for t in texts]
    assert together["lang"].tolist() == [a[0] for a in alone]
    assert max(abs(a[1] - b) for a, b in zip(alone, together["score"])) < 1e-9


def test_only_the_text_counts(spark, model, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    a = langid.classify(docs, model).select("doc_id", "lang_pred").collect()
    b = langid.classify(docs.selectExpr("doc_id", "text", "'xx' as lang", "'?' as source"), model)
    assert {tuple(r) for r in a} == {tuple(r) for r in b.select("doc_id", "lang_pred").collect()}


def test_odd_rows(odd, empty, model):
    found = langid.classify(odd, model)
    assert found.columns == [*odd.columns, "lang_pred", "lang_score"]
    for r in found.collect():
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["lang_score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in model.langs
    assert langid.identify(empty).collect() == []
    unlabelled = langid.identify(odd.drop("lang").selectExpr("*", "cast(null as string) as lang"))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
