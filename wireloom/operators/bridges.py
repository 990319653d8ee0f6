"""What each edge of a graph cuts off from the sources, for all edges in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Tables

#: Levels that one job adds up or passes down.
LEVELS = 3


def cut_off(edges: DataFrame, sources: DataFrame, weights: DataFrame) -> dict[str, DataFrame]:
    """losses (edge, below, lost_vertices, lost_weight) of each edge without which some vertex has no way to a source.

    edges (edge, a, b) are undirected, each with a name of its own; sources (vertex); weights (vertex, weight), none is 0.
    guards (vertex, level, guard, reached) tells for each vertex with a way to a source the nearest edge that cuts it
    off, null for none; the edge that cuts ``below`` off may have a guard itself, so that guards form a tree.

    A breadth-first forest grows from all sources at once.  An edge outside of it joins two vertices of the forest and
    saves every edge below which just one of them lies (two trees are both rooted in sources).  Each such edge has two
    64-bit hashes; their exclusive-or over a subtree is 0 where none leaves it, so a tree edge cuts its subtree off iff
    both are 0 (another case has odds of 2^-128 for each edge).  Sums run level by level from the leaves, so rounds grow
    with the depth of the forest, and hubs are summed before they are dealt.  Null names and ends are left out; loops
    cut nothing off.
    """
    tables = Tables(edges.sparkSession)
    known = tables.cut(edges.filter("edge IS NOT NULL AND a <> b").select("edge", "a", "b"), "known")
    both = tables.cut(known.select("a", "b", "edge").union(known.select("b", "a", "edge")), "both")
    nothing = F.lit(None).cast(edges.schema["edge"].dataType)
    root = sources.filter("vertex IS NOT NULL").select("vertex").distinct()
    levels, grown = [tables.cut(root.select("vertex", F.col("vertex").alias("parent"), nothing.alias("edge")), "level-0")], 1
    while grown:
        last = levels[-1]
        new = last.select(F.col("vertex").alias("a")).join(both, "a").groupBy(F.col("b").alias("vertex")).agg(F.min(F.struct("edge", F.col("a").alias("parent"))).alias("by"))
        for level in levels[-2:]:
            new = new.join(level.select("vertex"), "vertex", "left_anti")
        new, grown = tables.counted(new.select("vertex", "by.parent", "by.edge"), f"level-{len(levels)}", F.lit(True))
        levels.append(new)
    levels.pop()
    held = levels[0]
    for level in levels[1:]:
        held = held.union(level)
    spare = known.join(held.select("edge"), "edge", "left_anti").select(F.explode(F.array("a", "b")).alias("vertex"), F.xxhash64(F.lit("x"), "edge").alias("x"), F.xxhash64(F.lit("y"), "edge").alias("y"))
    spare = spare.groupBy("vertex").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    none = F.lit(0).cast("long")
    own = weights.filter("vertex IS NOT NULL").groupBy("vertex").agg(F.sum("weight").cast("long").alias("weight"))
    own = spare.select("vertex", "x", "y", none.alias("weight")).union(own.select("vertex", none, none, "weight"))
    own = tables.cut(own.groupBy("vertex").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("weight").alias("weight")), "own")
    sums, below = {}, None
    for n in range(len(levels) - 1, -1, -1):
        here = levels[n].join(own, "vertex", "left").select("vertex", "parent", "edge", F.lit(1).cast("long").alias("n"), *[F.coalesce(c, none).alias(c) for c in ("weight", "x", "y")])
        if below is not None:
            from_below = below.select(F.col("parent").alias("vertex"), "n", "weight", "x", "y")
            met = here.select("vertex", "n", "weight", "x", "y").union(from_below).groupBy("vertex").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
            here = levels[n].join(met, "vertex")
        below = sums[n] = tables.cut(here, f"sums-{n}") if (len(levels) - n) % LEVELS == 0 or n == 0 else here
    cuts = (F.col("x") == 0) & (F.col("y") == 0) & F.col("edge").isNotNull()
    guards = [sums[0].select("vertex", F.lit(0).alias("level"), nothing.alias("guard"), nothing.alias("reached"))]
    losses = None
    for n in range(1, len(levels)):
        lost = sums[n].filter(cuts).select("edge", F.col("vertex").alias("below"), F.col("n").alias("lost_vertices"), F.col("weight").alias("lost_weight"))
        losses = lost if losses is None else losses.union(lost)
        above = guards[-1].select(F.col("vertex").alias("parent"), F.col("guard").alias("before"))
        here = sums[n].withColumn("cuts", cuts).join(above, "parent").select("vertex", F.lit(n).alias("level"), F.when(F.col("cuts"), F.col("edge")).otherwise(F.col("before")).alias("guard"), F.col("edge").alias("reached"))
        guards.append(tables.cut(here, f"guards-{n}") if n % LEVELS == 0 else here)
    if losses is None:
        losses = sums[0].limit(0).select("edge", F.col("vertex").alias("below"), F.col("n").alias("lost_vertices"), F.col("weight").alias("lost_weight"))
    every = guards[0]
    for more in guards[1:]:
        every = every.union(more)
    result = {"losses": tables.cut(losses, "losses"), "guards": tables.cut(every, "guards")}
    tables.drop("known", "both", "own", *[f"{what}-{n}" for what in ("level", "sums", "guards") for n in range(len(levels) + 1)])
    return result
