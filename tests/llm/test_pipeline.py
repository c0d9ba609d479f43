import __spark_entry__
import corpus_pipeline


def test_stages_keep_their_contract(spark, small):
    first = spark.read.parquet(f"{small}/documents.parquet")
    docs, counts = first, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
        if name != "mixing":
            assert docs.columns == first.columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * first.count()
    assert {"doc_id", "taken", "target"} <= set(docs.columns)


def test_registered(spark, small):
    assert "pipeline" in __spark_entry__.queries()
    assert corpus_pipeline.run(spark, small).count() > 0
