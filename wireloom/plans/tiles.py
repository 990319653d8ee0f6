"""Manifests of tiles, crops and sheets: rectangle arithmetic only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiles(pages: DataFrame, rows: int, cols: int, overlap: float, dpi: float = 200.0) -> DataFrame:
    """Tiles of pages (page, width, height): a grid whose cells are widened by the overlap and clamped to the page."""
    cell = pages.withColumn("row", F.explode(F.sequence(F.lit(1), F.lit(rows)))).withColumn("col", F.explode(F.sequence(F.lit(1), F.lit(cols))))
    w, h = F.col("width") / cols, F.col("height") / rows
    zero, scale = F.lit(0.0), dpi / 72
    cell = cell.withColumn("x0", F.greatest(zero, (F.col("col") - 1) * w - overlap)).withColumn("y0", F.greatest(zero, (F.col("row") - 1) * h - overlap))
    cell = cell.withColumn("x1", F.least(F.col("width").cast("double"), F.col("col") * w + overlap)).withColumn("y1", F.least(F.col("height").cast("double"), F.col("row") * h + overlap))
    px = lambda a, b: ((F.col(b) - F.col(a)) * scale).cast("int")
    return cell.select("page", F.format_string("r%dc%d", "row", "col").alias("tile"), "row", "col", "x0", "y0", "x1", "y1", px("x0", "x1").alias("w"), px("y0", "y1").alias("h"))


def crop(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, pad: float = 2.5, dpi: float = 600.0) -> Column:
    """Pixel box of a padded crop, clamped to the page; too_small if a side has less than four pixels."""
    scale = dpi / 72
    at = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top * scale).cast("int")
    left, up, right, down = at((x0 - pad) * scale, width), at((y0 - pad) * scale, height), at((x1 + pad) * scale, width), at((y1 + pad) * scale, height)
    return F.struct(left.alias("left"), up.alias("top"), right.alias("right"), down.alias("bottom"), ((right - left < 4) | (down - up < 4)).alias("too_small"))


def sheets(items: DataFrame, key: list[str], order: list[str], per_sheet: int, cols: int) -> DataFrame:
    """items with their sheet, and row and column on it, in order."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    at = items.withColumn("wireloom_n", n)
    on = F.col("wireloom_n") % per_sheet
    return at.withColumn("sheet", (F.floor(F.col("wireloom_n") / per_sheet) + 1).cast("int")).withColumn("row", (F.floor(on / cols) + 1).cast("int")).withColumn("col", (on % cols + 1).cast("int")).drop("wireloom_n")


def crop_targets(names: DataFrame, queue: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """The labels to crop, no graphics: those that the review queue calls doubtful, or else those with the given ids.

    With ids each label has its ``place`` in the list, from 0 on, once for each time that it is listed there; ids that no
    label has are left out.
    """
    if ids is not None:
        listed = names.sparkSession.createDataFrame(list(enumerate(ids)), "place int, wireloom_id string")
        found = names.filter("orientation <> 'graphic'").join(F.broadcast(listed), F.col("id").cast("string") == F.col("wireloom_id"))  # a list that the caller holds
        return found.drop("wireloom_id")
    flagged = queue.filter("kind = 'low_confidence_label'").select("page", "id").distinct()
    return names.filter("orientation <> 'graphic'").join(flagged, ["page", "id"], "left_semi")


def annotated(names: DataFrame, tile: DataFrame, queue: DataFrame) -> DataFrame:
    """(tile, id, flagged, box on the tile) of the labels that lie on each tile of their page; flagged ones are in the review queue."""
    flags = queue.filter("kind = 'low_confidence_label'").select("page", F.col("id").alias("flag")).distinct()
    t = tile.select("page", "tile", F.col("x0").alias("tx0"), F.col("y0").alias("ty0"), F.col("x1").alias("tx1"), F.col("y1").alias("ty1"))
    on = names.join(t, "page").filter("x0 < tx1 AND x1 > tx0 AND y0 < ty1 AND y1 > ty0")  # a page has few tiles
    marked = on.join(flags.withColumnRenamed("page", "p"), (F.col("p") == F.col("page")) & (F.col("flag") == F.col("id")), "left")
    return marked.select("page", "tile", "id", F.col("flag").isNotNull().alias("flagged"), *[(F.col(c) - F.col(o)).alias(c) for c, o in (("x0", "tx0"), ("y0", "ty0"), ("x1", "tx0"), ("y1", "ty0"))])


def write_manifest(manifest: DataFrame, path: str, mode: str = "error") -> None:
    """A manifest of tiles, crops or sheets as JSON lines."""
    manifest.write.mode(mode).json(path)
