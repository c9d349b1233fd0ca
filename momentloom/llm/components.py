"""Connected components of a link table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each linked node reaches, itself included.

    Alternates large-star and small-star steps until the links are stars around each
    component's smallest node; the number of rounds grows with the logarithm of a
    component's size. Minima are combined before the shuffle, and only joins that
    adaptive execution can split meet a hub's links. Every round is a written table, the last one stays.
    Loops, repeated and null links count for nothing; no links give an empty table.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    edges = materialise(edges)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, large["a"] == least["u"]).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        older, edges = edges, materialise(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        remove_table(older)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
