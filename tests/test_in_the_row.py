"""Rows dealt over all cores; windows with features, caption lines, slots and files in a document's row against the same as rows."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from momentloom.operators import captions, scoring, segments
from momentloom.sources import tables

TEXTS = [None, "", "Short one. ", " ".join(f"why w{k}{'.' if k % 7 == 0 else ''} turned out?" for k in range(300)), " ".join(["Love ΟΔΟΣ", '"so," {he}', "said\\ straße!"] * 200), "step " * 900]


def docs_of(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_rows_of_one_row_group_are_dealt_over_all_cores(spark, tmp_path):
    noise = np.random.default_rng(0).bytes
    pq.write_table(pa.table({"doc_id": range(2000), "text": [noise(25_000).hex() for _ in range(2000)]}), f"{tmp_path}/documents.parquet", row_group_size=2000)
    whole = tables.table(spark, str(tmp_path), "documents")
    cores = spark.sparkContext.defaultParallelism
    assert whole.rdd.getNumPartitions() >= cores
    rows = [r["count"] for r in tables.documents(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 2000 and len(rows) >= cores and max(rows) <= 2 * 2000 / cores


def test_tables_that_lie_evenly_are_not_shuffled(spark, tmp_path):
    spark.range(4000).repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(f"{tmp_path}/documents.parquet")
    spark_conf = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        assert "Exchange" not in tables.documents(spark, str(tmp_path))._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", spark_conf)


def test_windows_have_the_features_of_their_texts(spark):
    lexicon = scoring.Lexicon(emotion=("love", "οδος"), story=("turned out", "w1", ""), practical=("step", "p s"))
    docs = docs_of(spark)
    got = scoring.featured_windows(docs, lexicon, True)
    names = ["doc_id", "j0", "j1", "start_ms", "end_ms", "natural", "text", "hook", "emotion", "opinion", "story", "practical", "questions", "quotable"]
    want = scoring.lexical_features(segments.candidate_windows(segments.segment_arrays(docs)), lexicon=lexicon)
    assert sorted(got.select(names).collect()) == sorted(want.select(names).collect()) and {r.doc_id for r in got.collect()} == {3, 4}
    ends = {r.doc_id: r.duration_ms for r in segments.with_target(segments.segment_arrays(docs)).filter("duration_ms is not null").collect()}
    assert all(r.duration_ms == ends[r.doc_id] for r in got.collect()) and scoring.featured_windows(docs, lexicon).columns == [c for c in got.columns if c != "text"]


def test_captions_in_the_row_equal_those_of_rows(spark):
    docs = docs_of(spark)
    clips = spark.createDataFrame([(3, 1, 1000, 60_000), (3, 2, 50_000, 50_100), (4, 1, 0, 90_000), (4, 2, 10**9, 10**9 + 5), (1, 1, 0, 9), (5, 7, 95, 20_000)], "doc_id long, clip long, t0 long, t1 long")
    lines = captions.caption_lines(captions.clip_words(docs, clips))
    events = captions.caption_events(lines)
    rows = lambda df, like: sorted(df.select(like.columns).collect())
    assert rows(captions.lined_words(docs, clips), lines) == rows(lines, lines) and lines.count() > 400
    assert rows(captions.events_of_clips(docs, clips), events) == rows(events, events)
    files = captions.subtitle_files(captions.subtitle_lines(events))
    assert rows(captions.files_of_clips(docs, clips), files) == rows(files, files)
    assert "Window" not in captions.events_of_clips(docs, clips)._jdf.queryExecution().toString()


def test_quantiles_are_those_of_numpy():
    r = np.random.default_rng(1)
    assert all(scoring.quantile_of(x, p) == np.quantile(x, p) for n in (1, 2, 3, 20, 21, 999) for p in (0.25, 0.5, 0.95) for x in (r.random(n), r.integers(0, 4, n) * 1.37))
