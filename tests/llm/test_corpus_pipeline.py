"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import corpus_pipeline
from fixtures import awkward, prose
from test_relational import brute_contamination
from test_llm_texts import brute_pii


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    texts = [t for t in prose(21, n=60, words=200, vocabulary=4000) if len(t.split()) > 90]
    copy = texts[3].split()
    copy[40] = "changed"
    item = "seven words of the benchmark stand here and three more words follow them"
    own = [t for t in prose(22, n=20, words=200, vocabulary=4000) if len(t.split()) > 90]
    texts += [texts[3], " ".join(copy), own[0] + " " + item, own[1] + " write me.now@mail.example.org", own[2] + " scum idiot trash"]
    docs = awkward(spark, texts)
    labels = [(i, 1, 0) for i in range(len(texts))]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixture"]
    n, out = len(texts), docs
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in out.collect()]
        out = stage(spark, out, str(tmp_path))
        after = [r.asDict() for r in out.collect()]
        if name != "mixture":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        ids = {r["doc_id"] for r in after}
        if name == "near_duplicates":
            assert {n - 5, n - 4} & ids == set() and 3 in ids and len(after) < len(before)
        if name == "decontamination":
            bad = {x[0] for x in brute_contamination([(r["doc_id"], r["text"]) for r in before], [(1, item)]) if x[5]}
            assert bad and ids == {r["doc_id"] for r in before} - bad
        if name == "personal_data":
            was = {r["doc_id"]: r["text"] for r in before}
            assert all(r["text"] == was[r["doc_id"]] for r in after if not brute_pii(was[r["doc_id"]]))
            assert next(r["text"] for r in after if r["doc_id"] == n - 2).endswith("<EMAIL>")
        if name == "mixture":
            sums = {}
            for r in after:
                sums.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
            assert all(t - 200 < s <= t + 1e-6 for t, s in sums.values()) and all(r["times"] in (1, 2) for r in after)
        out = spark.createDataFrame(out.collect(), out.schema) if name != "mixture" else out
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(str(r.doc_id) for r in whole.collect()) == sorted(str(r["doc_id"]) for r in after)
    assert whole.filter(F.col("times") > 2).count() == 0


def test_empty_tables(spark, tmp_path):
    docs = awkward(spark).limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == [] and out.dtypes == docs.dtypes
