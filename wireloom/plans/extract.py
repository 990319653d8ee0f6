"""The geometry layer: drawing primitives to labels, symbols, conductors, junctions, nets, a review queue and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bounds, centre, closed, horizontal_run, length, orientation, symbol_kind
from ..functions.text import corrected_lines, label_role, wire_spec
from ..operators import graph
from ..operators.lines import baseline_bands, text_lines
from ..operators.matching import greedy_match
from ..operators.spatial import band_join, nearest
from ..params import Params
from ..shared import cut

NET_KINDS = ("net_number", "voltage", "designator", "terminal_number", "text")
SPEC_KINDS = ("wire_spec", "wire_colour")
SHORT_KINDS = ("terminal_number", "designator", "net_number", "voltage")


def routed(primitives: DataFrame, prm: Params = Params()) -> DataFrame:
    """primitives (page, group_id, item, layer, op, x0, y0, x1, y1, group_x0 .. group_y1) with ``route``.

    stroke, segment, rect, circle (all curves of a round group) or dropped; layers restrict segments alone.
    """
    group = Window.partitionBy("page", "group_id")
    w, h = F.col("group_x1") - F.col("group_x0"), F.col("group_y1") - F.col("group_y0")
    round_ = F.min((F.col("op") == "c").cast("int")).over(group) == 1
    circle = round_ & (F.abs(w - h) < 0.6 * F.greatest(w, h))
    size = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    wanted = F.col("layer").isin(*prm.layers) if prm.layers else F.lit(True)
    line = F.col("op") == "l"
    route = (
        F.when(circle, "circle")
        .when(line & (size < prm.glyph_max_len), "stroke")
        .when(line & wanted & (size >= prm.wire_min_len), "segment")
        .when(F.col("op") == "c", "stroke")
        .when(F.col("op") == "re", "rect")
        .otherwise("dropped")
    )
    pages = primitives if prm.page is None else primitives.filter(F.col("page") == prm.page)
    return pages.withColumn("route", route)


def symbols(routes: DataFrame, prm: Params = Params()) -> DataFrame:
    box = routes.filter("route = 'circle'").select("page", "group_id", "layer", "group_x0", "group_y0", "group_x1", "group_y1").distinct()
    d = F.round(F.greatest(F.col("group_x1") - F.col("group_x0"), F.col("group_y1") - F.col("group_y0")), 2)
    box = box.withColumn("diameter", d).withColumn("c", centre(F.col("group_x0"), F.col("group_y0"), F.col("group_x1"), F.col("group_y1")))
    n = F.row_number().over(Window.partitionBy("page").orderBy("group_id"))
    return box.select("page", F.format_string("S%04d", n).alias("id"), symbol_kind(F.col("diameter"), prm.terminal_diameter).alias("kind"), F.col("c.x").alias("x"), F.col("c.y").alias("y"), "diameter", "layer")


def lines(routes: DataFrame, prm: Params = Params()) -> DataFrame:
    """Boxes of text lines with their orientation, from strokes."""
    strokes = routes.filter("route = 'stroke'").select("page", F.xxhash64("group_id", "item").alias("stroke"), "x0", "y0", "x1", "y1")
    glyphs = graph.glyph_clusters(strokes, prm).withColumn("id", F.format_string("G%020d", F.col("cluster")))
    text = text_lines(baseline_bands(glyphs, prm), prm)
    return text.withColumn("orientation", orientation(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), prm.text_max_height))


def labels(boxes: DataFrame, known_designators: list[str] | None = None) -> DataFrame:
    """Labels from boxes (page, x0, y0, x1, y1, orientation, raw): corrected text, confidence, role and ids in reading order."""
    n = F.row_number().over(Window.partitionBy("page").orderBy(F.round("y0", 1), "x0", "y0", "x1", "y1"))
    named = boxes.withColumn("id", F.format_string("T%04d", n)).withColumn("key", F.concat_ws("/", F.col("page").cast("string"), "id"))
    read = corrected_lines(named.select(F.col("key").alias("id"), F.coalesce("raw", F.lit("")).alias("raw")), known_designators)
    both = named.join(read.select(F.col("id").alias("key"), "text", "confidence"), "key")
    c = centre(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    kind = F.when(F.col("orientation") == "graphic", "graphic").otherwise(label_role(F.col("text")))
    return both.select("page", "id", "text", F.col("raw").alias("raw_ocr"), "confidence", kind.alias("kind"), "orientation", "x0", "y0", "x1", "y1", c["x"].alias("cx"), c["y"].alias("cy"))


def conductors(edges: DataFrame, prm: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Conductors and boxes from the edges of a page's graph."""
    runs = cut(graph.contract(edges), "runs")
    number = F.row_number().over(Window.partitionBy("page").orderBy("first_edge"))
    run = horizontal_run(F.col("points"), prm.ortho_tol)
    wires = runs.filter("conductor").select(
        "page", F.format_string("C%04d", number).alias("id"), "points", "node_ids", F.round(length(F.col("points")), 2).alias("length"), "segment_count", run.alias("run"),
        F.array(F.element_at("node_ids", 1), F.element_at("node_ids", -1)).alias("end_nodes"), F.array(F.element_at("points", 1), F.element_at("points", -1)).alias("endpoints"),
    )
    boxes = runs.filter("NOT conductor").select("page", F.format_string("B%04d", number).alias("id"), bounds(F.col("points")).alias("bbox"), F.size("points").alias("point_count"), closed(F.col("points")).alias("closed"))
    return wires, boxes


def candidates(wires: DataFrame, names: DataFrame, prm: Params = Params()) -> DataFrame:
    """(page, conductor, label, role, text, gap): labels above a level run for nets, below it for specifications."""
    runs = wires.filter("run IS NOT NULL").select("page", F.col("id").alias("conductor"), F.col("run.x0").alias("rx0"), F.col("run.x1").alias("rx1"), F.col("run.y").alias("ry"))
    usable = names.filter("orientation = 'h' AND text <> '' AND kind <> 'note'").select("page", F.col("id").alias("label"), "text", "kind", "x0", "y0", "x1", "y1")
    overlap = F.least("rx1", "x1") - F.greatest("rx0", "x0") >= prm.label_overlap * (F.col("x1") - F.col("x0"))
    both = band_join(runs, usable, ["page"], ("rx0", "rx1"), ("x0", "x1"), prm.label_bin, overlap)
    above, below = F.col("ry") - F.col("y1"), F.col("y0") - F.col("ry")
    role = F.when(F.col("kind").isin(*NET_KINDS) & (above > 0) & (above <= prm.label_gap), "net").when(F.col("kind").isin(*SPEC_KINDS) & (below > 0) & (below <= prm.label_gap), "spec")
    return both.withColumn("role", role).filter("role IS NOT NULL").select("page", "conductor", "label", "role", "text", F.when(F.col("role") == "net", above).otherwise(below).alias("gap"))


def attach(wires: DataFrame, names: DataFrame, prm: Params = Params()) -> DataFrame:
    """wires with net_label, spec_label, colour, gauge and label_ids; a label goes to one conductor at most."""
    taken = greedy_match(candidates(wires, names, prm), ["page", "label"], ["page", "conductor", "role"], ["gap", "conductor", "label"])
    pivot = taken.groupBy("page", F.col("conductor").alias("id")).agg(
        F.max(F.when(F.col("role") == "net", F.col("text"))).alias("net_label"), F.max(F.when(F.col("role") == "spec", F.col("text"))).alias("spec_label"), F.array_sort(F.collect_list("label")).alias("label_ids")
    )
    colour, gauge = wire_spec(F.col("spec_label"))
    joined = wires.join(pivot, ["page", "id"], "left")
    return joined.withColumn("color", F.when(F.col("spec_label").isNotNull(), colour)).withColumn("gauge", F.when(F.col("spec_label").isNotNull(), gauge)).withColumn("label_ids", F.coalesce("label_ids", F.array().cast("array<string>")))


def bindings(wires: DataFrame, marks: DataFrame, names: DataFrame, prm: Params = Params()) -> DataFrame:
    """(page, id, end, x, y, symbol_id, symbol_distance, label_id, label_distance): what each end of a conductor touches."""
    at = wires.select("page", "id", F.posexplode("endpoints").alias("end", "p")).select("page", "id", "end", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    targets = marks.select("page", F.col("id").alias("symbol"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    bound = nearest(at, targets, ["page"], ["id", "end"], ("x", "y"), ("sx", "sy"), "symbol", "symbol", prm.bind_radius)
    bound = bound.withColumnRenamed("nearest_id", "symbol_id").withColumnRenamed("nearest_distance", "symbol_distance")
    short = names.filter(F.col("kind").isin(*SHORT_KINDS)).select("page", F.col("id").alias("label"), F.col("cx").alias("lx"), F.col("cy").alias("ly"))
    bound = nearest(bound, short, ["page"], ["id", "end"], ("x", "y"), ("lx", "ly"), "label", "label", prm.bind_radius * prm.label_radius_factor)
    return bound.withColumnRenamed("nearest_id", "label_id").withColumnRenamed("nearest_distance", "label_distance")


def review_queue(names: DataFrame, wires: DataFrame, nets: DataFrame, prm: Params = Params()) -> DataFrame:
    """What a person has to look at: doubtful labels, conductors that lack something, nets with two names."""
    low = names.filter((F.col("orientation") != "graphic") & ((F.col("confidence") < prm.review_confidence) | (F.col("text") == "")))
    missing = F.array_compact(F.array(F.when(F.col("net_label").isNull(), "net_label"), F.when(F.col("color").isNull(), "color"), F.when(F.col("gauge").isNull(), "gauge")))
    parts = [
        low.select("page", F.lit("low_confidence_label").alias("kind"), "id", "raw_ocr", "text", "confidence"),
        wires.withColumn("missing", missing).filter(F.size("missing") > 0).select("page", F.lit("incomplete_conductor").alias("kind"), "id", "endpoints", "missing"),
        nets.filter("conflicting_labels").select("page", F.lit("net_label_conflict").alias("kind"), "id", "labels_seen", F.slice("member_conductors", 1, 20).alias("member_conductors")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def stats(routes: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(page, name, n): primitives by route and rows of each table."""
    out = routes.groupBy("page", F.concat(F.lit("route "), F.col("route")).alias("name")).agg(F.count("*").alias("n"))
    layers = routes.groupBy("page", F.concat(F.lit("layer "), F.coalesce("layer", F.lit("None"))).alias("name")).agg(F.count("*").alias("n"))
    out = out.union(layers)
    for name, df in tables.items():
        out = out.union(df.groupBy("page").agg(F.count("*").alias("n")).select("page", F.lit(name), "n"))
    return out


def counters(routes: DataFrame, tables: dict[str, DataFrame], prm: Params = Params()) -> DataFrame:
    """(page, name, n): the counts of a page, those with a condition included; one pass over each table.

    Every page that has a primitive or a row has every counter of that table.
    """
    counted = {
        "routes": {"glyph_strokes": F.col("route") == "stroke", "conductor_segments": F.col("route") == "segment"},
        "glyphs": {"glyph_clusters": F.lit(True)},
        "labels": {"text_labels": F.col("orientation") != "graphic", "labels_read": F.col("text") != "", "labels_low_confidence": (F.col("orientation") != "graphic") & (F.col("confidence") < prm.review_confidence)},
        "conductors": {"conductors": F.lit(True), "conductors_with_net_label": F.coalesce("net_label", F.lit("")) != "", "conductors_with_spec_label": F.coalesce("spec_label", F.lit("")) != ""},
        "junctions": {"junctions": F.lit(True)}, "boxes": {"boxes": F.lit(True)},
        "symbols": {"symbols_terminal_points": F.col("kind") == "terminal_point", "symbols_device_circles": F.col("kind") == "device_circle"},
        "nets": {"nets": F.lit(True), "nets_labelled": F.col("labelled")}, "review_queue": {"review_items": F.lit(True)},
    }
    out = None
    for table, conditions in counted.items():
        df = routes if table == "routes" else tables.get(table)
        if df is None:
            continue
        wide = df.groupBy("page").agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
        long = wide.select("page", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in conditions])))
        out = long if out is None else out.union(long)
    return out


def text_source(pages: DataFrame) -> DataFrame:
    """(has_embedded_text, text_source) of a document's pages (page, text): whether any page carries text of its own."""
    any_text = pages.agg(F.coalesce(F.bool_or(F.trim(F.coalesce("text", F.lit(""))) != ""), F.lit(False)).alias("has_embedded_text"))
    return any_text.withColumn("text_source", F.when(F.col("has_embedded_text"), "strokes, beside embedded text").otherwise("strokes alone: every label has to be verified"))


def extract(primitives: DataFrame, label_boxes: DataFrame | None = None, prm: Params = Params(), known_designators: list[str] | None = None) -> dict[str, DataFrame]:
    """All tables of the geometry layer.

    label_boxes (page, x0, y0, x1, y1, orientation, raw) carries text that was read elsewhere; without it labels are the
    boxes of text lines, with no text.
    """
    routes = cut(routed(primitives, prm), "routes")
    boxes = lines(routes, prm).withColumn("raw", F.lit(None).cast("string")) if label_boxes is None else label_boxes
    names = cut(labels(boxes, known_designators), "labels")
    marks = cut(symbols(routes, prm), "symbols")
    segments = routes.filter("route = 'segment'").select("page", F.xxhash64("group_id", "item").alias("h"), "group_id", "item", "x0", "y0", "x1", "y1")
    segments = segments.withColumn("seg", F.row_number().over(Window.partitionBy("page").orderBy("group_id", "item")).cast("long"))
    snap = {"cells": graph.snap_cells, "distance": graph.snap_nodes}[prm.node_rule]
    edges = cut(snap(segments.select("page", "seg", "x0", "y0", "x1", "y1"), prm), "edges")
    wires, loops = conductors(edges, prm)
    wires = cut(attach(wires, names, prm), "conductors")
    nets = cut(graph.nets(wires), "nets")
    crossings = graph.junctions(edges, prm)
    crossings = crossings.withColumn("id", F.format_string("J%04d", F.row_number().over(Window.partitionBy("page").orderBy("node"))))
    rects = routes.filter("route = 'rect'").select("page", "x0", "y0", "x1", "y1", F.round(F.col("x1") - F.col("x0"), 2).alias("width"), F.round(F.col("y1") - F.col("y0"), 2).alias("height"), "layer")
    out = {"labels": names, "symbols": marks, "conductors": wires, "boxes": loops, "junctions": crossings, "nets": nets, "rects": rects, "bindings": bindings(wires, marks, names, prm), "review_queue": review_queue(names, wires, nets, prm)}
    out["counters"] = counters(routes, out, prm)
    out["params"] = primitives.sparkSession.createDataFrame([(prm.to_json(),)], "params string")
    return out | {"stats": stats(routes, {k: v for k, v in out.items() if k not in ("bindings", "counters", "params")}), "dropped": routes.filter("route = 'dropped'")}
