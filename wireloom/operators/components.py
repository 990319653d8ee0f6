"""Connected components by alternating large and small stars, a published MapReduce method, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Tables, small_tasks


#: Lower ends with more than one in so many of all edges are hubs, fewer than this many.
HUBS = 500


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Each neighbour above a vertex is tied to the least of the vertex and its neighbours.

    As a > b in all edges, the least one is that of a's own edges, if there are such.  The few hubs are looked up by
    broadcast, so that no task gets all edges of one; the others are dealt by their lower end.
    """
    least = edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
    hubs = edges.groupBy("b").count().filter(F.col("count") > n // HUBS + 1).select(F.col("b").alias("v"))
    hubs = hubs.join(least, "v", "left").select("v", F.coalesce("m", "v").alias("hub_m"))
    held = edges.join(F.broadcast(hubs), F.col("b") == F.col("v"), "left").drop("v")
    rest = held.filter("hub_m IS NULL").join(least, F.col("b") == F.col("v"), "left").select("a", F.coalesce("m", "b").alias("b"))
    return rest.union(held.filter("hub_m IS NOT NULL").select("a", F.col("hub_m").alias("b"))).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A vertex and its neighbours below are tied to the least of these."""
    least = edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
    tied = edges.join(least, F.col("a") == F.col("v")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("v", "m")).distinct()


def _sign(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(vertex, component) of all vertices of edges (a, b) but the least of each component, which names it.

    A vertex keeps an edge to some lower vertex throughout, so hubs only grow at the names; their rows are summed
    before they are dealt.  Each round is written to the shared folder, in place of the one before; rounds grow with
    the logarithm of the vertices.  The result reads a table named "stars" of tables.
    """
    tables = tables or Tables(edges.sparkSession)
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    with small_tasks(edges.sparkSession):
        edges = tables.cut(edges, "stars")
        before = None
        while (now := _sign(edges)) != before and now[0]:
            before = now
            edges = tables.cut(_small(_large(edges, now[0])), "stars")
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
