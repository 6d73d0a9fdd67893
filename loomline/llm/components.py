"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _fingerprint(links: DataFrame) -> tuple[int, int | None, int | None]:
    """Number of links and two checksums of 64 bits; the links are distinct, so equal ones have the same."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is the smallest node in it.

    Each round hangs the larger neighbours of every node on its smallest neighbour, then the smaller
    ones. A round is an aggregation and a join, so a node of very many links is split like any
    skewed key. Rounds end when the links are stars; they are written to the shared folder, so a lost
    executor costs a round at most. Self links and repeated links do no harm.
    """
    now = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _fingerprint(now)
    while before[0]:
        both = _both(now)
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        new = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = written(new, "links")
        now, after = new, _fingerprint(new)
        if after == before:
            break
        before = after
    nodes = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
