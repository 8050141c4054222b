"""Connected components of link tables, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lasting, salted_join, temporary, written


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) for every node of the edges (a, b), longs. An edge to itself
    only names a node. Rows may repeat. Every round halves the distance to a component's root or better, moves each edge
    once for each star, and adds up per node before it shuffles. Each star is written: a plan of both would hold the first one
    three times, which the driver plans anew as each of its shuffles ends."""
    with temporary(edges.sparkSession):
        pairs = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
        while True:
            pairs = written(_small_star(written(_large_star(pairs))))
            ends = _ends(pairs)
            if ends.where("low <> high OR (low < u AND above)").isEmpty():  # all are stars around their smallest node
                return lasting(ends.select(F.col("u").alias("node"), F.col("least").alias("component")))


def _ends(pairs: DataFrame) -> DataFrame:
    """u, least (of its neighbourhood, u included) for each node of pairs (u, v) with v <= u; low and high, the least and the
    greatest of its smaller neighbours, null if there are none; above: whether it has larger ones."""
    lower = F.when(F.col("v") < F.col("u"), F.col("v"))
    up = pairs.select("u", "v", lower.alias("lower"), F.lit(False).alias("up"))
    both = up.union(pairs.where("v < u").select("v", "v", F.lit(None).cast("long"), F.lit(True)))
    return both.groupBy("u").agg(F.min("v").alias("least"), F.min("lower").alias("low"), F.max("lower").alias("high"), F.max("up").alias("above"))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Links each node's larger neighbours, and itself where it is named, to the least of its neighbourhood. No more rows than
    pairs has; they may repeat."""
    least = _ends(pairs).select(F.col("u").alias("v"), "least")
    return salted_join(pairs, least, ["v"], "u", "inner").select("u", F.col("least").alias("v"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Links each node's smaller neighbours and itself to the least of them. A node by itself stays linked to itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_join(pairs, least, ["u"], "v", "inner").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()
