import corpus_pipeline
from agentcorpus.llm import langid, lines, ordermin, packing


def test_stages_on_odd_rows(spark, odd, sf):
    docs, seen = odd, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        seen.append(name)
        assert docs.columns == odd.columns
    assert seen == ["language_id", "line_dedup", "near_dedup"]
    assert {r["doc_id"] for r in docs.collect()} <= {1, None, 6, 8, 9}


def test_decisions_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.language_id(spark, docs, sf)
    judged = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert {r["doc_id"] for r in first.collect()} == {
        k for k, r in judged.items() if r["lang_pred"] != "und" and r["lang_score"] >= corpus_pipeline.LEAST_SCORE
    }
    second = corpus_pipeline.line_dedup(spark, first, sf)
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(first).collect() if r["lines_kept"]}
    rows = second.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    third = corpus_pipeline.near_dedup(spark, second, sf)
    classes = {r["class_id"] for r in ordermin.near_duplicates(second).collect()}
    assert {r["doc_id"] for r in third.collect()} == classes


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and max(r["offset"] + r["length"] for r in rows) <= packing.WIDTH


def test_empty_table(spark, empty, sf):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []
