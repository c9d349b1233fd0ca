"""Names that are free: in order each row takes its stem, or stem_2, stem_3, ... - the first that none before it has.

A stem's rows take its numbers in order, so a row's number follows from its place among them, unless some
numbered name is itself the stem of other rows. Such a stem, "a_2" beside "a", either had its own name before a's
rows came to number 2, which then skip it, or it comes later and finds its name gone. These are decided
stem by stem, the shorter ones first: which numbers are skipped shifts which row comes to the next, so the decisions of
one stem are repeated until they agree with each other; all that have smaller numbers right are right after each
round, and usually all are after the first. Places run over ranges of the order (see ordered.py), so that
a million rows of one stem are worked on in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentloom.sources.scratch import written

from .ordered import places, ranges_before

#: A stem that is another's numbered name: that stem, and the number.
NUMBERED = r"(?s)^(.*)_([1-9][0-9]{0,8})$"


def _same(key: list[str], a: str, b: str) -> Column:
    """Whether two prefixed sides agree in all keys, nulls too."""
    out = F.lit(True)
    for k in key:
        out = out & F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}"))
    return out


def _rivals(stems: DataFrame, keys: list[str]) -> DataFrame:
    """Stems that are a numbered name of another stem of their key: keys, stem, parent, number, first (when their first row comes)."""
    named = stems.withColumn("parent", F.regexp_extract("stem", NUMBERED, 1)).withColumn("number", F.regexp_extract("stem", NUMBERED, 2).try_cast("long")).filter("number >= 2")
    parents = stems.select(*(F.col(k).alias(f"p_{k}") for k in keys), F.col("stem").alias("p_stem"), F.col("rows").alias("parent_rows"))
    return named.join(parents, _same(keys, "", "p_") & (F.col("parent") == F.col("p_stem"))).select(*keys, "stem", "parent", "number", "first", "parent_rows")


def _decided(level: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """level with skipped (the parent's rows skip this number) and lost (the parent's rows take this stem's name first).

    level: keys, stem, parent, number, first, parent_rows and gone (1 where the parent has lost its own name).
    """
    rows = ranked.select(*(F.col(k).alias(f"r_{k}") for k in keys), F.col("stem").alias("r_stem"), F.col("place").alias("r_place"), F.col("at").alias("r_at"))
    # All are taken for skipped at first: right where numbered stems come before the rows that would take their names.
    state = written(level.withColumns({"skipped": F.lit(True), "lost": F.lit(False)}))
    while True:
        counted = ranges_before(state, [*keys, "parent"], [F.col("number")], F.col("skipped").cast("long"), "below")
        # The row that comes to this number: the first takes number 2 where the parent's own name is gone, else the second does.
        comes = counted.withColumn("turn", F.col("number") - F.col("below") - F.col("gone")).withColumnsRenamed({"skipped": "was"})
        found = comes.join(rows, _same(keys, "", "r_") & (F.col("parent") == F.col("r_stem")) & (F.col("turn") == F.col("r_place")), "left")
        early = F.col("first") < F.col("r_at")
        after = written(found.select(*level.columns, "was", F.coalesce(early, F.lit(False)).alias("skipped"), F.coalesce(~early, F.lit(False)).alias("lost")))
        if after.filter("skipped != was").isEmpty():
            return after.drop("was")
        state = after.drop("was")


def unique_names(df: DataFrame, key: list[str], stem: str, order: list[str], suffix: str) -> DataFrame:
    """df with name, the stem or its first free numbered form, and suffix. key is the folder: names of different keys are apart.

    order must tell a key's rows apart. A null stem is an empty one, a null key a key like others; no rows give
    no rows. Names are free as to df's rows alone; what a folder holds already goes in as rows that come first.
    """
    keys = [f"k{i}" for i in range(len(key))]
    base = df.select(*(F.col(k).alias(n) for k, n in zip(key, keys, strict=True)), F.coalesce(F.col(stem).cast("string"), F.lit("")).alias("stem"), F.struct(*order).alias("at"), F.struct(*df.columns).alias("row"))
    ranked = written(places(base, [*keys, "stem"], [F.col("at")]))
    stems = written(ranked.groupBy(*keys, "stem").agg(F.min("at").alias("first"), F.count("*").alias("rows")))
    rivals = written(_rivals(stems, keys))
    plain = F.when(F.col("place") > 1, F.col("place"))
    if rivals.isEmpty():
        named = ranked.withColumn("number", plain)
    else:
        named = _shifted(ranked, rivals, keys)
    name = F.concat("stem", F.when(F.col("number").isNull(), F.lit("")).otherwise(F.concat(F.lit("_"), F.col("number"))), F.lit(suffix))
    return named.select("row.*", name.alias("name"))


def _shifted(ranked: DataFrame, rivals: DataFrame, keys: list[str]) -> DataFrame:
    """ranked with number, where some stems are others' numbered names."""
    level = written(rivals.join(rivals.select(*(F.col(k).alias(f"q_{k}") for k in keys), F.col("stem").alias("q_stem")), _same(keys, "", "q_") & (F.col("parent") == F.col("q_stem")), "left_anti").withColumn("gone", F.lit(0)))
    done: DataFrame | None = None
    # Level by level: a stem's own name is decided before the numbers of its rows are. As many as a stem has numbers at its end.
    while not level.isEmpty():
        decided = _decided(level, ranked, keys)
        done = decided if done is None else done.unionByName(decided)
        above = decided.select(*(F.col(k).alias(f"q_{k}") for k in keys), F.col("stem").alias("q_stem"), F.col("lost").cast("int").alias("gone"))
        level = written(rivals.join(above, _same(keys, "", "q_") & (F.col("parent") == F.col("q_stem"))).select(*rivals.columns, "gone"))
    done = written(done)
    lost = done.filter("lost").select(*(F.col(k).alias(f"q_{k}") for k in keys), F.col("stem").alias("q_stem"), F.lit(1).alias("gone"))
    # The free numbers before a skipped one: rows whose turn lies behind these pass it.
    skips = done.filter("skipped")
    below = ranges_before(skips.select(*keys, "parent", "number"), [*keys, "parent"], [F.col("number")], F.lit(1).cast("long"), "below")
    marks = below.select(*keys, F.col("parent").alias("stem"), (2 * (F.col("number") - 2 - F.col("below")) + 1).alias("turn"), F.col("number").alias("tie"), F.lit(1).cast("long").alias("one"))
    own = ranked.join(lost, _same(keys, "", "q_") & (F.col("stem") == F.col("q_stem")), "left").withColumn("turn", F.col("place") - 1 + F.coalesce("gone", F.lit(0)))
    own = own.select(*ranked.columns, "turn")
    # Stems none of whose numbers are skipped need no further pass over their rows.
    with_skips = marks.select(*(F.col(k).alias(f"q_{k}") for k in keys), F.col("stem").alias("q_stem")).distinct()
    touched = _same(keys, "", "q_") & (F.col("stem") == F.col("q_stem"))
    number = F.when(F.col("turn") > 0, F.col("turn") + 1 + F.col("passed"))
    still = own.join(with_skips, touched, "left_anti").withColumn("passed", F.lit(0).cast("long"))
    moved = own.join(with_skips, touched, "left_semi")
    both = moved.select(*keys, "stem", (2 * F.col("turn")).alias("turn"), F.lit(0).cast("long").alias("tie"), F.lit(0).cast("long").alias("one"), F.struct("place", "at", "row").alias("own"))
    both = both.unionByName(marks.withColumn("own", F.lit(None).cast(both.schema["own"].dataType)))
    passed = ranges_before(both, [*keys, "stem"], [F.col("turn"), F.col("tie")], F.col("one"), "passed").filter("own is not null")
    moved = passed.select(*keys, "stem", "own.at", "own.row", "own.place", F.expr("turn div 2").alias("turn"), "passed")
    return still.select(*moved.columns).unionByName(moved).withColumn("number", number)
