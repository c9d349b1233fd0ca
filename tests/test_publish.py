"""Published tables and resumable stages, with writers that fail half-way."""

import pytest
from pyspark.sql import functions as F

from momentloom.sources.publish import Folder, ResumableStage, publish, read_published


def failing(spark, n, parts=2):
    """A table whose last partition can't be made."""
    bad = F.when(F.col("id") == n - 1, F.raise_error(F.lit("no more"))).otherwise(F.col("id"))
    return spark.range(0, n, 1, parts).select(bad.alias("id"))


def test_readers_see_the_old_or_the_new_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        read_published(spark, path)
    first = publish(spark.range(5), path)
    old = read_published(spark, path)
    with pytest.raises(Exception, match="no more"):
        publish(failing(spark, 10), path)
    assert Folder(spark, path).read("_current") == first and read_published(spark, path).count() == 5
    assert len(Folder(spark, path).names("versions")) == 2
    # From itself, and what readers have begun to read stays.
    publish(read_published(spark, path).unionByName(spark.range(5, 8)), path)
    assert read_published(spark, path).count() == 8 and old.count() == 5
    for n in range(4):
        publish(spark.range(n), path)
    assert read_published(spark, path).count() == 3 and len(Folder(spark, path).names("versions")) <= 4
    publish(spark.range(0), path)
    assert read_published(spark, path).count() == 0
    assert not [n for n in Folder(spark, path).names() if n.startswith("_aside")]


def test_a_killed_stage_redoes_only_what_was_unfinished(spark, tmp_path):
    path, done = str(tmp_path / "s"), spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(k % 40 if k % 40 else None, k, "x") for k in range(200)], "key long, v long, name string")

    def work(df, fail_on=None):
        def one(frames):
            for f in frames:
                done.add(len(f))
                if fail_on in f["v"].tolist():
                    raise RuntimeError("killed")
                yield f[f["v"] != 39]

        return df.select("key", "v").mapInPandas(one, "key long, v long")

    stage = ResumableStage(spark, path, ["key"])
    order = {k: rows.filter(F.pmod(F.xxhash64("key"), F.lit(4)) == k).select("v").collect() for k in range(4)}
    with pytest.raises(Exception, match="RuntimeError: killed"):
        stage.run(rows, lambda df: work(df, fail_on=order[2][0].v), portions=4)
    finished = len(order[0]) + len(order[1])
    assert len(stage.parts()) == 2 and stage.unfinished(rows).count() == 200 - finished
    done.value = 0
    got = ResumableStage(spark, path, ["key"]).run(rows, work, portions=3)
    assert done.value == 200 - finished
    assert sorted(r.v for r in got.collect()) == [v for v in range(200) if v != 39]
    assert stage.sweep() == 1 and got.count() == 199
    # Nothing is left to do; rows of new keys are.
    done.value = 0
    more = rows.unionByName(spark.createDataFrame([(77, 1000, "y")], rows.schema))
    assert stage.run(rows, work).count() == 199 and done.value == 0
    assert stage.run(more, work).count() == 200 and done.value == 1
    assert ResumableStage(spark, str(tmp_path / "none"), ["key"]).run(rows.filter("false"), work).count() == 0
