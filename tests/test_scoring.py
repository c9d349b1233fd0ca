"""Outside scorers: batches, all or nothing, repeated rows; literal markers, ids of replies."""

import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from momentloom.operators import registry, scoring, segments


class Counting(scoring.Scorer):
    """Scores a window by its batch's size; fails for the windows given; answers nothing for texts of "?"."""

    def __init__(self, bad=()):
        self.bad = bad

    def score(self, frame):
        if frame["j0"].isin(self.bad).any():
            raise TimeoutError("too slow")
        rows = frame[frame["text"] != "?"]
        extra = pd.DataFrame({"doc_id": [1], "j0": [10**6], "score": [1.0]})
        return pd.concat([rows.assign(score=float(len(frame)), title="t" * 99, reason=None), extra])


def windows_of(spark):
    rows = [(1, k, "w") for k in range(25)] + [(2, k, "w") for k in range(100, 112)] + [(3, 200, "?"), (4, 300, "w"), (None, 400, "w"), (5, None, "w")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, j0 long, text string, batch int, failed string")


def test_batches_of_ten_in_order_and_failures_as_rows(spark):
    got = scoring.batch_scores(Counting(bad=(105,)), windows_of(spark), order=[F.desc("j0")]).collect()
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.batch), []).append(r)
    assert {k: len(v) for k, v in by.items()} == {(1, 0): 10, (1, 1): 10, (1, 2): 5, (2, 0): 1, (2, 1): 2, (3, 0): 1, (4, 0): 1, (None, 0): 1}
    assert sorted(r.j0 for r in by[1, 0]) == list(range(15, 25)) and {r.score for r in by[1, 2]} == {5.0}
    assert by[2, 0][0].failed == "TimeoutError: too slow" and by[2, 0][0].j0 is None
    assert by[3, 0][0].failed == "ValueError: no valid id" and by[1, 0][0].title == "t" * 80 and by[1, 0][0].reason == ""
    whole = scoring.whole_sources(scoring.batch_scores(Counting(bad=(105,)), windows_of(spark)))
    assert {r.doc_id for r in whole.collect()} == {1, 4, None}
    assert scoring.batch_scores(Counting(), windows_of(spark).filter("false")).count() == 0


def test_a_failed_batch_leaves_all_scores_of_its_source_local(spark):
    scoring.register_scorer("counting", lambda: Counting(bad=(3,)))
    w = windows_of(spark).filter("doc_id is not null and j0 is not null")
    local = w.select("doc_id", "j0", F.lit(7.0).alias("score"), F.lit("mine").alias("reason"))
    got = {(r.doc_id, r.j0): (r.score, r.provider, r.reason) for r in scoring.scored_by("counting", w, local).collect()}
    assert len(got) == 39 and {v for k, v in got.items() if k[0] in (1, 3)} == {(7.0, "local", "mine")}
    assert got[2, 100] == (10.0, "counting", "mine") and got[2, 111] == (2.0, "counting", "mine")


def test_repeated_remote_rows_count_once(spark):
    local = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 6.0), (None, 7.0)], "k long, score double")
    remote = spark.createDataFrame([(1, 90.0, 0), (1, 30.0, 1), (2, None, 0), (None, 1.0, 0)], "k long, score double, at int")
    rows = lambda **a: sorted((r.score, r.provider) for r in scoring.override_scores(local, remote, ["k"], "p", **a).collect())
    assert rows() == [(6.0, "local"), (7.0, "local"), (90.0, "p"), (90.0, "p")] and rows(order="at") == [(6.0, "local"), (7.0, "local"), (30.0, "p"), (30.0, "p")]
    jobs = spark.createDataFrame([(1, "rendering", 0), (2, "rendering", 0)], "job_id long, state string, active_s long")
    live = spark.createDataFrame([(1, "done"), (1, "rendering"), (2, "done"), (2, "done"), (2, None)], "job_id long, state string")
    assert sorted((r.job_id, r.deletable) for r in registry.deletable(jobs, live, F.lit(10_000)).collect()) == [(1, False), (2, True)]


def test_markers_are_letters_not_patterns(spark):
    df = spark.createDataFrame([("C++ and c",), ("c c c++ c++",), ("",), (None,)], "text string")
    got = scoring.lexical_features(df, lexicon=scoring.Lexicon(story=("c++",), practical=("aa", ""))).select("story").collect()
    assert [r.story and round(r.story, 6) for r in got] == [round(1 / 3, 6), round(2 / 3, 6), 0.0, None]


def test_number_ids_are_cut(spark):
    text = '[{"id": 3.7, "score": 5}, {"id": "2", "score": 6}, {"id": -0.5, "score": 9}, {"id": null, "score": 1}, {"id": 1e300, "score": 1}]'
    got = scoring.parse_replies(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t", 0, 9).collect()
    assert sorted((r.id, r.score) for r in got) == [(0, 9.0), (2, 6.0), (3, 5.0)]


def test_a_titles_capital_is_one_letter(spark):
    texts = ["| ßab | cd und.", "ﬁne Words.", "éTÉ là.", "?!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", scoring.title_of(F.col("text")).alias("title")).collect()
    assert [r.title for r in sorted(rows)] == ["ẞab | cd und", "ﬁne words", "Été là", "Untitled moment"]


def test_counts_of_sentences_add_up():
    lexicon = scoring.Lexicon(emotion=("ab",), opinion=("c.",), story=("aa", "b. a"), practical=("", "?"))
    count = scoring.counter(lexicon)
    for text in ("", " ", "ab b. aab aaaa c. b? ?\x0b x", "aaa.  a a a a. ab b. ab b. ab", "b. b. ab"):
        tokens = [w for w in re.split(r"[ \t-\r]+", text) if w]
        parts = [p for p in re.split(r"(?<=[.!?])[ \t-\r]+", text) if p.strip(" \t\x0b")]
        short = sum(4 <= len([w for w in re.split(r"[ \t-\r]+", p) if w]) <= 12 for p in parts)
        assert count(text) == [len(tokens), tokens.count("ab"), tokens.count("c."), text.count("aa") + text.count("b. a"), text.count("?"), text.count("?"), short]


def test_windows_and_batches_take_no_group_or_array_function_each(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    df = spark.createDataFrame([(d, j, "One two. Three?") for d in (1, 2, None) for j in range(23)], "doc_id long, j0 long, text string")
    said = scoring.batch_scores(Counting(), df)
    assert "FlatMapGroups" not in plan(said) and sorted(Counter((r.doc_id or 0, r.batch) for r in said.collect()).values()) == [3] * 3 + [10] * 6
    assert "aggregate(" not in plan(segments.candidate_windows(segments.segment_arrays(df))) and "transform(split" not in plan(scoring.lexical_features(df))
