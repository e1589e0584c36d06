"""Connected components over a table of links, as repeated joins on hash partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import discard, written

#: A node's least neighbour is repeated so often for the join with its links: a hub's links go to
#: several tasks, and, as both sides are dealt anew, Spark may split them further.
SALTS = 4


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    salted = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("s", F.pmod(F.hash("v"), F.lit(SALTS))).join(salted, ["graph", "u", "s"]).drop("s")


def _settled(edges: DataFrame) -> bool:
    """Whether the links (u > v, each once) are stars: each u has one v, and no v is a u."""
    ends = edges.select("graph", F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(edges.select("graph", F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
    return ends.groupBy("graph", "node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).where("ups > 1 OR (ups = 1 AND downs = 1)").isEmpty()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(graph, node, component) for the nodes of links(graph, a, b); component is the smallest reachable node.

    Several graphs, told apart by ``graph``, are worked on at once.  Alternates large-star and
    small-star steps until the links are stars.  Each step is one aggregation with map-side minimum
    and one join, so a hub's links may be split over tasks.  Links with a null end and links of a
    node with itself are dropped.  Lineage is cut after each round by a written table.
    """
    u, v = F.greatest("a", "b"), F.least("a", "b")
    edges = written(links.where("a <> b").select("graph", u.alias("u"), v.alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select("graph", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("graph", "u").agg(F.min("v").alias("m")).select("graph", "u", F.least("u", "m").alias("m"))
        large = _with_least(both, least).where("v > u").select("graph", F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("graph", "u").agg(F.min("v").alias("m"))
        sides = F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e")
        small = _with_least(large, least).select("graph", sides).select("graph", F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u > v")
        old, edges = edges, written(small.distinct(), "edges")
        discard(old)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("graph", F.col("v").alias("node")).distinct()
    return edges.select("graph", F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("graph", "node", F.col("node").alias("component")))
