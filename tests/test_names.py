"""Free names against the plain loop, on stems that look like each other's numbered names."""

import random

import pytest

from momentloom.operators import names
from tests.test_ordered import many_ranges  # noqa: F401


def plain(rows):
    taken, out = set(), {}
    for k, folder, stem in sorted(rows, key=lambda r: r[0]):
        own, n = stem or "", 2
        name = own
        while (folder, name) in taken:
            name, n = f"{own}_{n}", n + 1
        taken.add((folder, name))
        out[k] = f"{name}.mp4"
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "k long, folder string, stem string, name string, place int").drop("name")
    out = names.unique_names(df, ["folder"], "stem", ["k"], ".mp4")
    assert out.columns == ["k", "folder", "stem", "place", "name"]
    return {r.k: r.name for r in out.collect()}


def test_names_equal_the_loop_on_rival_stems(spark):
    rng = random.Random(7)
    pool = ["a", "a", "a", "a_2", "a_3", "a_2_2", "a_2_3", "a_02", "a_1", "a_4", "b", "b_2", "", None, "_2", "a_3_2_2", "a_12"]
    rows = [(k, rng.choice(["v", "w", None]), rng.choice(pool)) for k in range(260)]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("kind", ["before", "after", "between", "none"])
def test_long_families(many_ranges, kind):  # noqa: F811
    """Numbered stems before, behind and among the rows that would take their names; more than rows, and fewer."""
    own = [(k, "v", "clip") for k in range(1000, 1400)]
    rival = {"before": [(k, "v", f"clip_{k}") for k in range(2, 700)], "after": [(2000 + k, "v", f"clip_{k}") for k in range(2, 700, 3)], "between": [(1000 * (k % 2) + 1500 * (k % 3 == 0) + k, "v", f"clip_{1 + k % 577}") for k in range(2, 600, 5)], "none": []}[kind]
    rows = list({r[0]: r for r in [*own, *rival]}.values())
    assert got(many_ranges, rows) == plain(rows)


def test_no_rows_give_no_names(spark):
    assert names.unique_names(spark.createDataFrame([], "k long, folder string, stem string"), ["folder"], "stem", ["k"], "").count() == 0
