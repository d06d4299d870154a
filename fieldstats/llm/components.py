"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.common import gathered


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component_id``, the smallest id reachable, of every id in ``edges`` (a, b).

    Large-star and small-star steps in turn: each points an id's larger, then its smaller
    neighbours at the smallest one around, until all edges do: then an id has larger neighbours
    only, or one smaller. Steps grow with the logarithm of
    the longest path. Minima are combined before the shuffle, and the join that hands
    them out has one row per id on one side, so an id with many neighbours can be split.
    Each step is kept in the shared folder. Self-loops and repeated edges do no harm.
    """
    now = gathered(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = gathered(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        if around.filter((F.col("m") < F.col("a")) & (F.col("n") > 1)).isEmpty():
            return around.select(F.col("a").alias("id"), F.least("a", "m").alias("component_id"))
        least = around.select(F.col("a").alias("_of"), F.least("a", "m").alias("m"))
        large = (
            both.filter(F.col("b") > F.col("a"))
            .join(least.select((F.col("_of") + 0).alias("_of"), "m"), F.col("a") == F.col("_of"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).select((F.col("a") + 0).alias("_of"), "m")
        small = (
            large.join(lowest, F.col("a") == F.col("_of"))
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .filter(F.col("a") != F.col("b"))
            .distinct()
        )
        now = gathered(small)


def joined(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``parts`` (of ``components``) with more edges (a, b).

    Only the components that an edge brings together are worked on; ids that ``parts`` does
    not have are their own so far.
    """
    own = lambda c: parts.select(F.col("id").alias(c), F.col("component_id").alias(f"_{c}"))
    between = gathered(
        edges.join(own("a"), "a", "left")
        .join(own("b"), "b", "left")
        .select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        .filter("a != b")
    )
    if between.isEmpty():
        return parts
    merged = components(between).select(F.col("id").alias("_root"), F.col("component_id").alias("_to"))
    # Roots that were alone are in no row of parts yet.
    ids = parts.unionByName(merged.select(F.col("_root").alias("id"), F.col("_root").alias("component_id"))).distinct()
    return gathered(
        ids.join(merged, ids["component_id"] == merged["_root"], "left").select("id", F.coalesce("_to", "component_id").alias("component_id"))
    )
