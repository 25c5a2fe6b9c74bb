import corpus_pipeline
from harbinger.llm.decontaminate import contaminated
from harbinger.llm.near_dedup import link_documents
from harbinger.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == columns
            assert after.join(docs, "doc_id", "left_anti").count() == 0
        else:
            assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
        if name == "near_dedup":
            assert link_documents(after, 5).where("not kept").count() == 0
            gone = docs.join(after, "doc_id", "left_anti").select("doc_id")
            assert {r[0] for r in gone.collect()} == {r[0] for r in link_documents(docs, 5).where("not kept").collect()}
        if name == "decontamination":
            assert contaminated(after, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
        if name == "secrets":
            assert after.where("text rlike '[0-9a-f]{32,}'").count() == 0
        seen.append(name)
        docs = after
    assert seen == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]


def test_run_returns_the_last_stage(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in out.select("doc_id").distinct().collect()} == {None, 1, 4, 5, 6, 7, 9, 10}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
