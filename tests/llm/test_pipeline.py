"""The pipeline's stages, one after the other, on awkward rows and on an empty table."""

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    item = "which of the nine bridges over the river was built first answer the stone one near the mill in the old town"
    leak = spark.createDataFrame([(300, "intro words " + item + " closing words")], "doc_id bigint, text string")
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(leak, allowMissingColumns=True)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, 1, 0), (9, 1, 0), (12, 0, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.save(stage(spark, docs, folder), name)
        assert docs.columns == columns, name
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= {r.doc_id for r in before.collect()}
        if name == "near_duplicates":
            assert 5 in ids and not ids & {6, 7}
        if name == "decontamination":
            assert 300 not in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == ids


def test_run_and_empty(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
