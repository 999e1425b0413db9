"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import shuffles_dropped, staged


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link every larger (large star) or every smaller (small star) neighbour of a node, and in a small star the
    node itself, to the smallest of the node and its neighbours. Minima are grouped, so a node with very many
    links is summed up before the shuffle and its links are never gathered in one place."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if small:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), the component being its smallest node.

    Each round is written to the shared folder; rounds end when the links stay as they are. Loops and repeated
    links are ignored; rows with a null end too.
    """
    edges = staged(links.where(F.col("a") != F.col("b")).select("a", "b"), "links")
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = None
    while True:
        with shuffles_dropped(links.sparkSession):
            edges = staged(_star(_star(edges, False), True), "links")
            now = state(edges)
        if now == before:
            break
        before = now
    stars = edges.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
