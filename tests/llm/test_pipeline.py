import zlib

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == counts[4]
    assert sorted(map(tuple, pieces.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_good_documents_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(labels, "doc_id", "left_semi")
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    assert kept.count() >= 0.9 * docs.count()


def test_edge_rows_pass_all_stages(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "a b " * 60, "en", None, 5), (3, "a b " * 60, "en", None, 5), (None, "c d e f " * 40, "en", "s", None), (4, "longword" * 200_000, None, "s", 1), (5, "word and more. " * 60_000, "xx", "s", 1)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name in ("kept", "t", "i", "ids", "h", "component_id"):
            docs = docs.withColumn(name, F.lit(name))
        for name, stage in corpus_pipeline.STAGES[1:] if data else corpus_pipeline.STAGES:
            found = stage(spark, docs, SF).collect()
            assert len(found) >= len(set(rows)) if data else not found, name
            docs = docs if name == "packing" else spark.createDataFrame(found, schema)
    kept = corpus_pipeline.quality_stage(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert all(r.text for r in kept)


def test_bad_documents_go(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, sf).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    bad, good = [r.doc_id in kept for r in held if not r.quality], [r.doc_id in kept for r in held if r.quality]
    assert bad and sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.9 * len(good)
