"""Connected components of a table of links, by alternating large and small stars.

Each round joins every node with the least of its neighbours; the number of rounds grows with
the logarithm of the longest chain. A node with many links is never one row or one task: the
least neighbour is a combining aggregate, and the join back is left to AQE's skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """(a, b) with b the new, smaller end. ``edges`` has a > b."""
    if large:
        edges = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"),
                                                             F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    joined = edges.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionAll(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link (a, b); the component is its least
    node. Nulls and links of a node with itself are left out; no links give no rows."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    state = None
    while True:
        edges = stored(_stars(_stars(edges, True), False), "edges")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
                          .distinct())


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) with further links (a, b): only the links between
    components are gone through, of which there are few once most nodes are joined."""
    across = stored(_named(_named(links, parts, "a"), parts, "b").filter("a <> b").distinct(), "links")
    moved = stored(components(across), "moved").select(
        F.col("node").alias("component"), F.col("component").alias("_to"))
    new = across.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(
        parts, "node", "left_anti").select("node", F.col("node").alias("component"))
    return parts.unionAll(new).join(moved, "component", "left").select(
        "node", F.coalesce("_to", "component").alias("component"))


def _named(links: DataFrame, parts: DataFrame, end: str) -> DataFrame:
    """Links with one end replaced by its component."""
    return links.join(parts.withColumnRenamed("node", end), end, "left").withColumn(
        end, F.coalesce("component", end)).drop("component")
