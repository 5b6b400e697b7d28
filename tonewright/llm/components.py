"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop, materialize


def _lowered(pairs: DataFrame, keep_all: bool) -> DataFrame:
    """Per node u, m = the least of u and its partners: partners above u (or all of them) are linked to m instead of u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    moved = pairs.join(least, "u").where(F.lit(True) if keep_all else F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep_all:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v")


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, root), root being the least node reachable; nodes that are roots have no row.

    Links stay distributed; each round is written to the shared folder. Repeated
    links, self-links and both directions are allowed. The rounds end when a round changes
    no link; their number grows with the logarithm of the longest chain.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    now = materialize(links.where("a <> b").select(b.alias("u"), a.alias("v")).distinct(), "links")
    state = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    seen = state(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowered(both, keep_all=False)
        small = _lowered(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), keep_all=True)
        new = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        drop(now)
        now, last = new, seen
        seen = state(now)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
