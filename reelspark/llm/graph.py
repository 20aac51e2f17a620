"""Connected components by alternating large-star and small-star steps; roots of
a forest by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    hop = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hop.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """Components of an undirected graph of BIGINT nodes.

    ``edges`` has columns ``u, v``.  Returns ``node, component``: a row for each
    node that has an edge to another node, with the smallest node reachable.
    Self-loops and edges with a null end are ignored; repeated edges count once;
    an empty table gives an empty result.  Each step is one partial aggregate
    and one join on the node; every round is written to the shared folder.  A
    hub's edges are an ordinary sort-merge join side, which Spark splits when
    it is skewed.  A large star makes at most one edge of each that it reads, so
    repeats are only removed once a round.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v")
    )
    e = work.table(e.distinct())
    seen = None
    while True:
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or seen == (n, total):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = (n, total)
        nxt = work.table(_small_star(_large_star(e)))
        work.drop(e)
        e = nxt


def forest_roots(parents: DataFrame, work: Workspace) -> DataFrame:
    """Roots of a forest given as ``u, v``: the parent ``v < u`` of each ``u``,
    which occurs once.

    Returns ``node, root`` for each ``u``; the roots have no row.  An empty table
    gives an empty result.  Each round is one join of the pointers with
    themselves, which Spark splits at a parent of many, and halves the depth.
    """
    e = parents.select("u", "v")
    written = None
    while True:
        up = e.select(F.col("u").alias("v"), F.col("v").alias("above"))
        nxt = work.table(e.join(up, "v", "left").select("u", F.coalesce("above", "v").alias("v"), F.col("above").isNotNull().alias("moved")))
        if written is not None:
            work.drop(written)
        written, e = nxt, nxt.select("u", "v")
        if nxt.where("moved").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
