"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapmill.storage import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node (greater ones, or smaller ones and itself) to the least of them.

    The least neighbour of each node is a map-side combined minimum that is written first, so
    that the join with the links can split the many links of one node over tasks.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.col("u"), F.min("b")).alias("m")) if large else both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    low = materialize(low, "star")
    met = both.join(low, F.col("a") == F.col("u"))
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.where("a > b")
    out = materialize(out if large else out.distinct(), "links")
    release(low)
    release(edges)
    return out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component), as a written table, of every node of an undirected link table; the component is its smallest node.

    Self links and repeated links change nothing; a null end makes a link void. No link gives an empty table.
    """
    x, y = F.col(a), F.col(b)
    edges = materialize(links.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "links")
    while True:
        edges = _star(_star(edges, True), False)
        # All is done when each node has one link at most, and none if others are linked to it.
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")
    release(edges)
    return out
