"""Text lines from glyph boxes: baseline bands, then runs of glyphs with small gaps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params
from ..shared import cut, walk


def _islands(glyphs: DataFrame, tolerance: float) -> DataFrame:
    """glyphs with ``island``: islands of a page lie so far apart in y that no band spans two of them.

    The running mean of a band lies within its centres, so a gap of the tolerance closes it; the slack covers rounding.
    No gap is inside a cell as high as the tolerance, so cells, not glyphs, are put in order.
    """
    nan = F.lit(float("nan"))
    centred = glyphs.withColumn("yc", F.coalesce((F.col("y0") + F.col("y1")) / 2, nan))
    cell = F.when(F.isnan("yc"), F.lit(2**63 - 1)).otherwise(F.floor(F.col("yc") / tolerance))
    centred = centred.withColumn("cell", cell)
    cells = centred.groupBy(F.col("page").alias("p"), F.col("cell").alias("c")).agg(F.min("yc").alias("low"), F.max("yc").alias("high"))
    before = F.lag("high").over(Window.partitionBy("p").orderBy("c"))
    new = F.col("low") - before > tolerance + 1e-6 * (F.abs("low") + F.abs(before))
    cells = cells.withColumn("new", F.coalesce(new.cast("int"), F.lit(0)))
    cells = cells.select("p", "c", F.sum("new").over(Window.partitionBy("p").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    return centred.join(cells, F.col("page").eqNullSafe(F.col("p")) & (F.col("cell") == F.col("c")))


def _band_walk(tolerance: float):
    def start():
        """Each glyph joins the first band whose running mean is within the tolerance, or opens a new one.

        Centres come in order and a band opens only beyond all others, so none but the last can take a glyph.
        """
        band, total, count = -1, 0.0, 0

        def step(row):
            nonlocal band, total, count
            if row is None:
                return []
            page, island, y, x0, id_, y0, x1, y1 = row
            if band < 0 or not abs(y - total / count) < tolerance:
                band, total, count = band + 1, 0.0, 0
            total += y
            count += 1
            return [(page, island, id_, x0, y0, x1, y1, band)]

        return step

    return start


def baseline_bands(glyphs: DataFrame, prm: Params = Params()) -> DataFrame:
    """glyphs (page, id, x0, y0, x1, y1) with their baseline band.

    The walk is sequential by definition; it runs through each island of a page by itself and holds one band.
    """
    rows = _islands(glyphs.select("page", "id", "x0", "y0", "x1", "y1"), prm.baseline_tol).select("page", "island", "yc", "x0", "id", "y0", "x1", "y1")
    schema = "page int, island long, id string, x0 double, y0 double, x1 double, y1 double, band int"
    out = pa.schema([("page", pa.int32()), ("island", pa.int64()), ("id", pa.string()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1")), ("band", pa.int32())])
    order = [F.col("yc").asc(), F.col("x0").asc_nulls_last(), F.col("id").asc_nulls_last()]
    local = cut(walk(rows, ["page", "island"], order, _band_walk(prm.baseline_tol), schema, out), "bands")
    counts = local.groupBy(F.col("page").alias("p"), F.col("island").alias("i")).agg((F.max("band") + 1).alias("n"))
    below = F.sum("n").over(Window.partitionBy("p").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("p", "i", F.coalesce(below, F.lit(0)).alias("below"))
    both = local.join(counts, F.col("page").eqNullSafe(F.col("p")) & (F.col("island") == F.col("i")))
    return both.select("page", "id", "x0", "y0", "x1", "y1", (F.col("band") + F.col("below")).cast("int").alias("band"))


def _line_walk(gap_factor: float):
    def pick(f, *values):
        return f((v for v in values if v is not None), default=None)

    def height(y0, y1):
        return None if y0 is None or y1 is None else y1 - y0

    def start():
        line, box = -1, None

        def step(row):
            nonlocal line, box
            closed = [] if box is None else [box]
            if row is None:
                return closed
            page, band, x0, _, y0, x1, y1 = row
            if box is not None:
                _, _, _, bx0, by0, bx1, by1, n = box
                tall = pick(max, height(by0, by1), height(y0, y1), 3.0)
                if x0 is not None and bx1 is not None and x0 - bx1 < gap_factor * tall:
                    box = (page, band, line, pick(min, bx0, x0), pick(min, by0, y0), pick(max, bx1, x1), pick(max, by1, y1), n + 1)
                    return []
            line += 1
            box = (page, band, line, x0, y0, x1, y1, 1)
            return closed

        return step

    return start


def text_lines(banded: DataFrame, prm: Params = Params()) -> DataFrame:
    """Boxes of text lines (page, band, line, x0, y0, x1, y1, glyphs): a walk over each band's glyphs in x order.

    A glyph joins the line so far if the gap to its growing box is below gap_factor times the larger height.  The
    height is that of the line so far, so where a line ends depends on where it began; only its box is held.
    """
    schema = "page int, band int, line int, x0 double, y0 double, x1 double, y1 double, glyphs int"
    out = pa.schema([("page", pa.int32()), ("band", pa.int32()), ("line", pa.int32()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1")), ("glyphs", pa.int32())])
    return walk(banded.select("page", "band", "x0", "id", "y0", "x1", "y1"), ["page", "band"], ["x0", "id", "y0", "x1"], _line_walk(prm.gap_factor), schema, out)


def gap_islands(df: DataFrame, key: list[str], at: str, order: list[str], gap: float) -> DataFrame:
    """df with ``island``: a new one begins where ``at`` lies more than gap after the row before, within key."""
    window = Window.partitionBy(*key).orderBy(*order)
    new = F.coalesce((F.col(at) - F.lag(at).over(window) > gap).cast("int"), F.lit(1))
    return df.withColumn("wireloom_new", new).withColumn("island", F.sum("wireloom_new").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("wireloom_new")
