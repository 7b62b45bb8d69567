"""Distributed connected components by alternating large-star and small-star
steps (Kiveris et al., 2014): joins and minimum aggregates only.

The number of rounds grows with the logarithm of the longest path. No component
is ever gathered in one task: a star's centre is found by a minimum aggregate
with map-side partials, and handed to its neighbours by an equi-join, which
Spark's adaptive execution can split when one centre holds most edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm.scratch import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of long):
    the component is its smallest node. Self-loops and repeated edges are
    allowed; null ends are ignored; no edges give no rows."""
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .filter("u is not null and v is not null and u != v").distinct())
    # edges point from the larger node u to the smaller node v
    e = saved(e, "edges")
    while not _stars(e):
        e = saved(_small_star(_large_star(e)), "edges")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def merged(comps: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) when ``links`` are added to the components ``comps``: only the components
    that they touch are joined anew, so the work follows the new links, not the graph."""
    def of(x):
        return comps.select(F.col("node").alias(x), F.col("component").alias("c_" + x))
    touched = links.join(of(a), a, "left").join(of(b), b, "left").select(
        F.coalesce("c_" + a, a).alias("u"), F.coalesce("c_" + b, b).alias("v"))
    roots = saved(components(touched, "u", "v"), "roots")
    old = comps.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    # a node of the links that was in no component is its own, and now another's member
    new = roots.join(comps.select(F.col("component").alias("node")).distinct(), "node", "left_anti")
    return saved(old.select("node", F.coalesce("root", "component").alias("component")).unionByName(new), "components")


def _stars(e: DataFrame) -> bool:
    """Whether each component is a star around its least node: every larger end has one
    edge, and no smaller end is a larger end of another edge."""
    n = e.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if n is None or n > 1:
        return n is None
    return e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    """Each larger neighbour of u is linked to the least of u and its neighbours."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Each smaller neighbour of u, and u itself, is linked to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = (e.join(least, "u").filter("v != m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).distinct()
