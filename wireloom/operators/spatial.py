"""Band, grid and nearest-neighbour joins as equi-joins on bins: no nested-loop plan, no extra shuffle for duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(value: Column, width: float) -> Column:
    return F.floor(value / width)


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float, condition: Column | None = None) -> DataFrame:
    """Pairs with equal ``on`` whose spans [low, high] overlap, and that meet the condition.

    Each side is dealt to the bins that its span touches; a pair is kept in the first bin that both touch.  Column
    names other than ``on`` must differ.  Spans with a null or reversed end touch no bin.
    """
    def dealt(df, low, high, first, name):
        some = df.filter(F.col(low) <= F.col(high))
        return some.withColumn(first, _bin(F.col(low), width)).withColumn(name, F.explode(F.sequence(F.col(first), _bin(F.col(high), width))))

    a = dealt(left, *left_span, "wireloom_l", "wireloom_bin")
    b = dealt(right, *right_span, "wireloom_r", "wireloom_bin")
    both = a.join(b, [*on, "wireloom_bin"]).filter(F.col("wireloom_bin") == F.greatest("wireloom_l", "wireloom_r"))
    both = both.filter((F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1])))
    return (both if condition is None else both.filter(condition)).drop("wireloom_l", "wireloom_r", "wireloom_bin")


def grid_neighbours(left: DataFrame, right: DataFrame, on: list[str], left_xy: tuple[str, str], right_xy: tuple[str, str], cell: float) -> DataFrame:
    """Pairs with equal ``on`` in the same or adjoining cells of a square grid; the right side is dealt to nine cells."""
    near = F.sequence(F.lit(-1), F.lit(1))
    a = left.withColumn("wireloom_cx", _bin(F.col(left_xy[0]), cell)).withColumn("wireloom_cy", _bin(F.col(left_xy[1]), cell))
    b = right.withColumn("wireloom_dx", F.explode(near)).withColumn("wireloom_dy", F.explode(near))
    b = b.withColumn("wireloom_cx", _bin(F.col(right_xy[0]), cell) + F.col("wireloom_dx")).withColumn("wireloom_cy", _bin(F.col(right_xy[1]), cell) + F.col("wireloom_dy")).drop("wireloom_dx", "wireloom_dy")
    return a.join(b, [*on, "wireloom_cx", "wireloom_cy"]).drop("wireloom_cx", "wireloom_cy")


def nearest(points: DataFrame, targets: DataFrame, on: list[str], key: list[str], xy: tuple[str, str], target_xy: tuple[str, str], target_id: str, ordinal: str, radius: float) -> DataFrame:
    """points with ``nearest_id`` and ``nearest_distance`` of the closest target within radius, ties by ordinal; else null.

    key: columns that tell points apart together with ``on``.
    """
    both = grid_neighbours(points.select(*on, *key, *xy), targets, on, xy, target_xy, radius)
    d = F.hypot(F.col(xy[0]) - F.col(target_xy[0]), F.col(xy[1]) - F.col(target_xy[1]))
    within = both.withColumn("wireloom_d", d).filter(F.col("wireloom_d") <= radius)
    best = within.groupBy(*on, *key).agg(F.min(F.struct(F.col("wireloom_d").alias("d"), F.col(ordinal).alias("ordinal"), F.col(target_id).alias("target"))).alias("wireloom_best"))
    return points.join(best, [*on, *key], "left").withColumn("nearest_id", F.col("wireloom_best.target")).withColumn("nearest_distance", F.col("wireloom_best.d")).drop("wireloom_best")
