import corpus_pipeline
from tests.llm.helpers import DOCS


def test_stages_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == DOCS.names and after.count() <= before.count() and after.count() > 0.5 * before.count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, sf)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in packed.collect()}


def test_staged_tables_can_be_dropped(spark):
    import os

    from tidemark.llm import common

    common.staged(spark.range(3).toDF("x"), "gone").count()
    path = common._STAGED[-1]
    assert os.path.isdir(path.removeprefix("file://"))
    common.drop_staged(spark)
    assert not os.path.exists(path.removeprefix("file://")) and not common._STAGED
