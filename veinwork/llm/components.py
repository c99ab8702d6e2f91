"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veinwork.llm.scratch import drop, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of those."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of the undirected edges (a, b): the smallest node that it can reach.

    Alternates large-star and small-star steps until nothing moves. Every step is a grouped minimum, which
    combines before it shuffles, and a join; nothing is gathered. Self-loops and repeated edges do no harm; an empty edge list
    gives an empty result.
    """
    now = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    state = None
    while True:
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not got["n"] or got == state:
            break
        state = got
        before, now = now, stage(_small_star(_large_star(now)), "edges")
        drop(before)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    ).distinct()
