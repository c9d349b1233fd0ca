"""Ranked moments and clips in documents' rows against the chain of tables, also where rows share an id."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from momentloom.operators import moments, scoring
from momentloom.plans import candidate_queries, caption_queries, catalog

NAMES = [
    "pre_rank_slice", "nms_kept", "weak_tail", "ranked_candidates", "approved_clips", "word_overlap", "scene_cut_frames", "speech_mask", "speech_threshold",
    "caption_lines", "caption_events", "caption_overlaps", "ass_lines", "ass_files", "ass_roundtrip",
]


def texts():
    r = np.random.default_rng(3)
    words = ["why", "Love", "THE", "tion", "ΟΔΟΣ", "straße", "a", "{b}\\", "ver?", "ciÓN", "wait.", "then!", "x ", "end…", " ", "so,"]
    made = [" ".join(r.choice(words, n)) for n in (0, 1, 150, 400, 2500, 9000)]
    return [None, "", " \n", *made, "one.\ttwo\x0bthree. " * 500, "w " * 3000, "step. " * 300, " lead " + "\n\n".join(["Why so? no"] * 300) + ".\n"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The texts with ids of their own, and with ids that some rows share (null among them) beside others that are their own."""
    out = {}
    t = texts()
    for name, ids in (("apart", list(range(len(t)))), ("shared", [None if k % 4 == 0 else min(k, 6) if k % 2 else k for k in range(len(t))])):
        out[name] = str(tmp_path_factory.mktemp(name))
        pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": t}), f"{out[name]}/documents.parquet")
    return out


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("ids", ["apart", "shared"])
def test_in_rows_equals_the_chain_of_tables(spark, tables, monkeypatch, name, ids):
    got = catalog.QUERIES[name](spark, tables[ids])
    found = rows(got)
    if ids == "apart":
        assert not any(x in got._jdf.queryExecution().optimizedPlan().toString() for x in ("Window", "Aggregate")) and found
    monkeypatch.setattr(moments, "in_rows", lambda docs, alone, together: together(docs))
    assert found == rows(catalog.QUERIES[name](spark, tables[ids]))


def test_energies_equal_those_of_the_bins(spark, tables):
    docs = candidate_queries._docs(spark, tables["apart"])
    windows = candidate_queries._windows(spark, tables["apart"]).select("doc_id", "j0", "start_ms", "end_ms")
    want = scoring.window_energy(windows, candidate_queries.energy_bins(spark, tables["apart"]))
    assert rows(candidate_queries.energy_scores(spark, tables["apart"])) == rows(want) and docs.count() == len(texts())


def test_many_words_count_as_few_do():
    lexicon = candidate_queries.PROSE
    words = [w for w in {*" ".join(x or "" for x in texts()).split(), *(f"Er{k}?er.Und" for k in range(200)), "ER", "Und", "ΟΔΟΣ", "La"}]
    many, few = scoring.WordCounts(lexicon), scoring.WordCounts(lexicon)
    many.learn([w.encode() for w in words])
    assert len(words) > scoring.FEW and all((many.table[many[w.encode()]] == few.table[few[w]]).all() for w in words) and many.table.sum() > 200


def test_lines_are_parsed(spark):
    lines = spark.createDataFrame([("Dialogue: 0,1:02:03.04,1:02:05.00,Cap",), (" Dialogue: 0,0:00:01.00,0:00:02.00,x",), ("Dialogue: 0,0:0:01.00,0:00:02.00,x",)], "line string")
    assert [tuple(r)[1:] for r in caption_queries.K.parse_subtitles(lines).collect()] == [(3723040, 3725000)]
