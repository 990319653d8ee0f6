"""Points, boxes and polylines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def centre(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Centre of a box, to two places (half up)."""
    return F.struct(F.round((x0 + x1) / 2, 2).alias("x"), F.round((y0 + y1) / 2, 2).alias("y"))


def orientation(x0: Column, y0: Column, x1: Column, y1: Column, line_height: float = 12.0) -> Column:
    """h for a line of text, v for one that stands upright, else graphic."""
    w, h = x1 - x0, y1 - y0
    return F.when(h <= line_height, "h").when((w > 0) & (w <= line_height) & (h / w > 2), "v").otherwise("graphic")


def symbol_kind(diameter: Column, terminal: float = 5.0) -> Column:
    return F.when(diameter <= terminal, "terminal_point").otherwise("device_circle")


def pairs(points: Column) -> Column:
    """Consecutive points as structs (a, b)."""
    n = F.size(points)
    return F.when(n < 2, F.slice(F.arrays_zip(points.alias("a"), points.alias("b")), 1, 0)).otherwise(F.arrays_zip(F.slice(points, 1, n - 1).alias("a"), F.slice(points, 2, n - 1).alias("b")))


def length(points: Column) -> Column:
    return F.aggregate(pairs(points), F.lit(0.0), lambda total, p: total + F.hypot(p["a"]["x"] - p["b"]["x"], p["a"]["y"] - p["b"]["y"]))


def horizontal_run(points: Column, flat: float = 0.25) -> Column:
    """(x0, x1, y) of the longest stretch that is level, the first of these; null if there is none."""
    level = F.filter(pairs(points), lambda p: F.abs(p["a"]["y"] - p["b"]["y"]) <= flat)
    ranked = F.transform(level, lambda p, k: F.struct(F.abs(p["a"]["x"] - p["b"]["x"]).alias("span"), (-k).alias("k"), F.least(p["a"]["x"], p["b"]["x"]).alias("x0"), F.greatest(p["a"]["x"], p["b"]["x"]).alias("x1"), p["a"]["y"].alias("y")))
    best = F.array_max(F.filter(ranked, lambda r: r["span"] > 0))
    return F.when(best.isNotNull(), F.struct(best["x0"].alias("x0"), best["x1"].alias("x1"), best["y"].alias("y")))


def bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def closed(points: Column, gap: float = 1.0) -> Column:
    a, b = F.element_at(points, 1), F.element_at(points, -1)
    return distance(a["x"], a["y"], b["x"], b["y"]) < gap
