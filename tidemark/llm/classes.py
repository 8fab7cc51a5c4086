"""Connected components of a graph that is spread over the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for the ends of links (a, b): label is the least node of the component.

    Alternates two star operations: every node hands its larger neighbours to its least one, then its smaller ones and
    itself. A hub's row count stays its number of links, and its least neighbour is found by an aggregation before the
    shuffle. Ends when the links are stars. An empty graph gives no rows.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = _star(both, F.col("b") > F.col("a"))
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = written(_star(down, F.lit(True)), "stars")
        # an order-free sum over the rows tells whether anything has changed
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label"))
    return ends.union(ends.select(F.col("label").alias("node"), "label")).distinct()


def _star(edges: DataFrame, moved) -> DataFrame:
    """Links each moved neighbour b of a node a, and a itself, to the least of a and its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    to = edges.where(moved).join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    own = least.select(F.col("a").alias("x"), F.col("m").alias("y"))
    return to.union(own).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
