"""What stages leave on disk and in their workers while later ones run."""

import random
import time

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from momentloom.llm import common, jaccard, packing, quality

SF = "/root/testdata/sf0.001"


def _shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_unlike_long_texts_do_not_reach_whole_sets(spark, monkeypatch):
    """Sets of over 2,300 shingles pass any bitmap of 1,024 bits; each pair would take two whole sets."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    common_words = [word() for _ in range(400)]
    texts = [" ".join([*common_words, *(word() for _ in range(3200 + 40 * k))]) for k in range(12)]
    own = texts[0].split()
    near = " ".join(own[:-200] + [word() for _ in range(200)])
    tables = []
    monkeypatch.setattr(jaccard, "materialise", lambda df: tables.append(common.materialise(df)) or tables[-1])
    monkeypatch.setattr(jaccard, "remove_table", lambda df: None, raising=False)
    found = jaccard.jaccard_components(spark.createDataFrame([*enumerate(texts), (99, near)], "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {**{k: k for k in range(12)}, 99: 0}
    close = [df.count() for df in tables if "h1_a" in df.columns]
    assert len(close) == 2 and sum(close) == 1


def test_bitmaps_of_any_size_bound_the_overlap():
    rng = np.random.default_rng(2)
    for n, m in ((3, 3), (900, 1100), (1000, 1250), (4000, 4200), (4096, 5000), (9000, 9000), (20000, 24000)):
        values = np.unique(rng.integers(0, 1 << 63, 2 * (n + m), np.uint64))
        rng.shuffle(values)
        for share in (0, 40, 80, 100):
            both = min(n, -(-share * (n + m) // (100 + share)))
            sets = [np.sort(values[:n]), np.sort(values[n - both : n - both + m])]
            bits = [np.frombuffer(jaccard.set_bits(s), np.uint64) for s in sets]
            links = 100 * both >= 80 * (n + m - both)
            for y in (bits[1], bits[1][None]):
                keep = jaccard.set_bound(bits[0][None], y, np.array([n + m]), 80)
                assert keep.all() or not links
                assert not keep.any() or share >= 80


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    common.materialise(df)
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left


def test_measures_are_written_without_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = set(common._written)
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    tables = [spark.read.parquet(path) for s, path in common._written if (s, path) not in known]
    assert tables and all("text" not in t.columns for t in tables)
    assert kept.columns == corpus_pipeline.COLUMNS


def test_verdicts_meet_their_own_rows(spark):
    long = " ".join(f"word{k}" for k in range(200)) + "."
    again = "same words here " * 40
    rows = [(1, long, "en", "a", 1), (1, long, "en", "b", 2), (1, again, "en", "c", 3), (None, long, None, None, None), (None, again, None, None, None), (2, None, "en", "d", 4), (3, "", None, "e", 5)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    found = corpus_pipeline.quality_stage(spark, docs, SF).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str(r) for r in rows if r[1] == long)


def test_a_run_keeps_only_the_last_stages_tables(spark):
    known = set(common._written)
    result = corpus_pipeline.run(spark, SF)
    left = [spark.read.parquet(path).columns for s, path in common._written if (s, path) not in known]
    assert len(left) == 2 and corpus_pipeline.COLUMNS in left
    assert result.count() > 0


def test_a_new_cache_drops_the_others():
    ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = packing.document_tokens(*ranks)
    assert packing.document_tokens(*ranks) is tokens
    known = quality.fertility(quality._paths(quality.VOCABULARIES))
    assert not packing._made and quality.fertility(quality._paths(quality.VOCABULARIES)) is known
    packing.document_tokens(*ranks)
    assert packing._made and not quality._made
