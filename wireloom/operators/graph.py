"""Planar conductor graphs: nodes, degrees, junctions, contracted runs, loops and nets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..params import Params
from ..shared import Tables, cut, numbered, small_tasks, walk
from .components import components


def _snap_walk(tol: float):
    def start():
        cells: dict[tuple[int, int], list[int]] = {}
        nodes: list[tuple[float, float, int, int]] = []

        def step(row):
            if row is None:
                return []
            _, page, _, at, end, x, y = row
            cx, cy = round(x / tol), round(y / tol)
            near = [k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in cells.get((cx + i, cy + j), ())]
            for k in sorted(near):
                if (nodes[k][0] - x) ** 2 + (nodes[k][1] - y) ** 2 <= tol * tol:
                    return [(page, at, end, *nodes[k])]
            cells.setdefault((cx, cy), []).append(len(nodes))
            nodes.append((x, y, at, end))
            return [(page, at, end, *nodes[-1])]

        return step

    return start


def snap_nodes(segments: DataFrame, prm: Params = Params()) -> DataFrame:
    """segments (page, seg, x0, y0, x1, y1) as edges (page, edge, a, b, ax, ay, bx, by, length) between snapped nodes.

    An end takes the first node within node_tol in the 3 x 3 cells around it, in the order of segments.  Ends whose
    cells are not tied by adjoining cells never meet, so the walk runs through each component of cells by itself and
    holds its nodes.
    """
    tol = prm.node_tol
    # nodes are numbered by page in the order of segments; equal seg are told apart by their place
    own = cut(segments.select("page", "seg", "x0", "y0", "x1", "y1").withColumn("row", F.monotonically_increasing_id()), "segments")
    end = lambda k: F.struct(F.lit(k).alias("end"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    points = own.select("page", "seg", "row", F.explode(F.array(end(0), end(1))).alias("e")).select("page", "seg", "row", "e.*")
    cell = lambda c: F.rint(F.col(c) / tol).cast("long")
    points = points.withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    key = lambda x, y: F.xxhash64("page", x, y)
    cells = points.select("page", "cx", "cy").distinct()
    step = F.sequence(F.lit(-1), F.lit(1))
    near = cells.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).filter("(dx, dy) > (0, 0)").select("page", F.col("cx").alias("ox"), F.col("cy").alias("oy"), (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    found = components(near.join(cells, ["page", "cx", "cy"]).select(key("ox", "oy").alias("a"), key("cx", "cy").alias("b")))
    tied = points.withColumn("v", key("cx", "cy")).join(found, F.col("vertex") == F.col("v"), "left")
    rows = tied.select(F.coalesce("component", "v").alias("group"), "page", "seg", "row", "end", "x", "y")
    schema = "page int, row long, end int, x double, y double, first_row long, first_end int"
    out = pa.schema([("page", pa.int32()), ("row", pa.int64()), ("end", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("first_row", pa.int64()), ("first_end", pa.int32())])
    snapped = cut(walk(rows, ["group", "page"], ["seg", "row", "end"], _snap_walk(tol), schema, out), "snapped")
    first = snapped.filter("row = first_row AND end = first_end").select("page", "row", "end").join(own.select("seg", "row"), "row")
    number = first.select(F.col("row").alias("first_row"), F.col("end").alias("first_end"), (F.row_number().over(Window.partitionBy("page").orderBy("seg", "row", "end")) - 1).cast("long").alias("node"))
    named = snapped.join(number, ["first_row", "first_end"])
    one = lambda k, n: named.filter(F.col("end") == k).select("row", F.col("node").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    edges = own.select("page", F.col("seg").alias("edge"), "row").join(one(0, "a"), "row").join(one(1, "b"), "row").filter("a <> b")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return edges.select("page", "edge", "a", "b", "ax", "ay", "bx", "by", F.sqrt(dx * dx + dy * dy).alias("length"))


#: Rounds in which cells decide at once; what depends on longer chains of earlier cells is walked.
ROUNDS = 6
#: The order in which the cells around an end are looked through.
PROBES = [(dx, dy) for dx in (0, -1, 1) for dy in (0, -1, 1)]


def _cell_walk():
    nodes: set[tuple[int, int]] = set()

    def step(row):
        if row is None:
            return []
        _, page, _, _, _, cx, cy = row
        if any((cx + dx, cy + dy) in nodes for dx, dy in PROBES):
            return []
        nodes.add((cx, cy))
        return [(page, cx, cy)]

    return step


def _node_cells(cells: DataFrame, tables: Tables) -> DataFrame:
    """(page, cx, cy) of the cells (page, cx, cy, born) that get a node: those next to no such cell born earlier.

    A cell whose earlier neighbours are all decided is decided next, so rounds take whole fronts; what is left after
    ``ROUNDS``, where decisions hang on each other in longer chains, is walked by components, in the order of birth.
    """
    at = ["page", "cx", "cy"]
    other = F.struct((F.col("cx") + F.col("d.dx")).alias("ox"), (F.col("cy") + F.col("d.dy")).alias("oy"))
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in PROBES if (dx, dy) != (0, 0)])).alias("d")
    near = cells.select(*at, "born", around).select(*at, "born", other.alias("o")).select(*at, "born", "o.*")
    earlier = near.join(cells.select("page", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("born").alias("before")), ["page", "ox", "oy"]).filter("before < born")
    earlier = tables.cut(earlier.select(*at, "ox", "oy"), "earlier")
    open_, left, found = cells.select(*at), 1, []
    for k in range(ROUNDS):
        first = tables.cut(open_.join(earlier, at, "left_anti"), f"first-{k}")
        found.append(first)
        taken = earlier.join(first.select("page", F.col("cx").alias("ox"), F.col("cy").alias("oy")), ["page", "ox", "oy"], "left_semi").select(*at).distinct()
        open_, left = tables.counted(open_.join(first, at, "left_anti").join(taken, at, "left_anti"), "open", F.lit(True))
        if not left:
            break
        still = open_.select("page", F.col("cx").alias("ox"), F.col("cy").alias("oy"))
        earlier = tables.cut(earlier.join(open_, at, "left_semi").join(still, ["page", "ox", "oy"], "left_semi"), "earlier")
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.union(more)
    if left:
        key = lambda x, y: F.xxhash64("page", x, y)
        tied = components(earlier.select(key("cx", "cy").alias("a"), key("ox", "oy").alias("b")))
        rows = open_.join(cells, at).withColumn("v", key("cx", "cy")).join(tied, F.col("vertex") == F.col("v"), "left")
        rows = rows.select(F.coalesce("component", "v").alias("group"), "page", "born.seg", "born.row", "born.end", "cx", "cy")
        page = rows.schema["page"].dataType
        out = pa.schema([("page", to_arrow_type(page)), ("cx", pa.int64()), ("cy", pa.int64())])
        nodes = nodes.union(walk(rows, ["group", "page"], ["seg", "row", "end"], _cell_walk, f"page {page.simpleString()}, cx long, cy long", out))
    return nodes


def snap_cells(segments: DataFrame, prm: Params = Params()) -> DataFrame:
    """``snap_nodes`` by the cells' own rule: an end takes the node of the first of the 3 x 3 cells around it that has one.

    Cells are node_tol wide about its multiples (halves to even), and looked through in the order of ``PROBES``; a cell
    has one node at most, that of the end that found none.  So ends of one and the same node may be two cells apart, and
    ends within the tolerance may get two nodes.  Nodes lie where their first end does, to two digits.

    Only the first end of a cell can make its node, so a cell decides once: ends are first reduced to cells, these
    decide in rounds (``_node_cells``), and each end then looks up the nodes that were there before it.
    """
    tables = Tables(segments.sparkSession)
    own = tables.cut(segments.select("page", "seg", "x0", "y0", "x1", "y1").withColumn("row", F.monotonically_increasing_id()), "segments")
    end = lambda k: F.struct(F.lit(k).alias("end"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    points = own.select("page", "seg", "row", F.explode(F.array(end(0), end(1))).alias("e")).select("page", "seg", "row", "e.*")
    cell = lambda c: F.rint(F.col(c) / prm.node_tol).cast("long")
    points = points.withColumn("cx", cell("x")).withColumn("cy", cell("y")).withColumn("born", F.struct("seg", "row", "end"))
    cells = tables.cut(points.groupBy("page", "cx", "cy").agg(F.min("born").alias("born"), F.min_by(F.struct("x", "y"), "born").alias("p")), "cells")
    nodes = _node_cells(cells.select("page", "cx", "cy", "born"), tables).join(cells, ["page", "cx", "cy"])
    nodes = tables.cut(nodes.select("page", "cx", "cy", "born.*", F.round("p.x", 2).alias("nx"), F.round("p.y", 2).alias("ny")), "nodes")
    placed = numbered(nodes, ["page", "seg", "row", "end"], "place")
    first = placed.groupBy("page").agg(F.min("place").alias("low"))
    nodes = tables.cut(placed.join(first, "page").withColumn("node", F.col("place") - F.col("low")), "numbered")
    seen_from = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(PROBES)])).alias("d")
    seen = nodes.select("page", F.struct("seg", "row", "end").alias("since"), "node", "nx", "ny", "cx", "cy", seen_from)
    seen = seen.select("page", (F.col("cx") - F.col("d.dx")).alias("cx"), (F.col("cy") - F.col("d.dy")).alias("cy"), "since", F.struct("d.rank", "node", "nx", "ny").alias("found"))
    met = points.join(seen, ["page", "cx", "cy"]).filter("since <= born")
    side = lambda k: F.min(F.when(F.col("end") == k, F.col("found")))
    tied = met.groupBy("row").agg(side(0).alias("a"), side(1).alias("b")).filter("a.node <> b.node")
    dx, dy = F.col("a.nx") - F.col("b.nx"), F.col("a.ny") - F.col("b.ny")
    edges = own.select("page", F.col("seg").alias("edge"), "row").join(tied, "row")
    made = edges.select("page", "edge", F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.nx").alias("ax"), F.col("a.ny").alias("ay"), F.col("b.nx").alias("bx"), F.col("b.ny").alias("by"), F.sqrt(dx * dx + dy * dy).alias("length"))
    made = tables.cut(made, "made")
    tables.drop(*[name for name in list(tables.paths) if name != "made"])
    return made


def ends(edges: DataFrame) -> DataFrame:
    """A row for each end of each edge."""
    return edges.select("page", "edge", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("b").alias("node"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e")).select("page", "edge", "e.*")


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("page", "node").agg(F.count("*").cast("int").alias("degree"), F.min("x").alias("x"), F.min("y").alias("y"))


def junctions(edges: DataFrame, prm: Params = Params()) -> DataFrame:
    """Nodes where three or more edges meet; documented_junctions leaves out crossings of two straight lines."""
    found = degrees(edges).filter("degree >= 3")
    if prm.documented_junctions:
        sides = ends(edges).join(edges.select("page", "edge", "a", "b", "ax", "ay", "bx", "by"), ["page", "edge"])
        level = F.abs(F.col("ay") - F.col("by")) <= 0.25
        upright = F.abs(F.col("ax") - F.col("bx")) <= 0.25
        crossing = sides.groupBy("page", "node").agg(F.count_if(level).alias("h"), F.count_if(upright).alias("v"), F.count("*").alias("n")).filter("n = 4 AND h = 2 AND v = 2")
        found = found.join(crossing.select("page", "node"), ["page", "node"], "left_anti")
    return found


def _ranked(darts: DataFrame, tables: Tables, name: str) -> tuple[DataFrame, DataFrame]:
    """Of darts (dart, next, node), those with an end: (dart, last, hops), and the others, which go round: (dart, low).

    Pointers double: a round adds what a dart's pointer has passed to what it has passed itself.  last is the dart at
    the end of the list and hops the darts to it; low is the least node (where a dart leads to) of a loop.  Darts that
    know their end rest.  Once a round lets none rest, all others are loops, and after as many doublings as the number
    of them has bits each has seen its whole loop.
    """
    rest = darts.filter("next IS NULL").select("dart", F.col("dart").alias("last"), F.lit(0).cast("long").alias("hops"))
    rest = [tables.cut(rest, f"{name}-rest-0")]
    go, left = tables.counted(darts.filter("next IS NOT NULL").select("dart", "next", "node", F.col("node").alias("low"), F.lit(1).cast("long").alias("hops")), f"{name}-go", F.lit(True))
    seen, round_ = None, 0
    while left and not (seen == left and 1 << round_ >= left):
        round_ += 1
        ended = rest[-1]
        for r in rest[:-1]:
            ended = ended.union(r)
        there = go.select(F.col("dart").alias("d"), F.col("next").alias("after"), F.col("low").alias("l"), F.col("hops").alias("h"), F.lit(None).cast("long").alias("last"))
        there = there.union(ended.select("dart", F.lit(None).cast("long"), F.lit(None).cast("long"), "hops", "last"))
        met = tables.cut(go.join(there, F.col("d") == F.col("next")).select("dart", F.col("after").alias("next"), "node", F.least("low", "l").alias("low"), (F.col("hops") + F.col("h")).alias("hops"), "last"), f"{name}-met-{round_ % 2}")
        rest.append(tables.cut(met.filter("last IS NOT NULL").select("dart", "last", "hops"), f"{name}-rest-{round_}"))
        seen = left
        go, left = tables.counted(met.filter("last IS NULL").drop("last"), f"{name}-go", F.lit(True))
    ended = rest[0]
    for r in rest[1:]:
        ended = ended.union(r)
    return ended, go.select("dart", "low")


#: Edges of a run that one task holds.
HELD = 20_000
PLACED = ["page", "run", "place", "edge", "length", "node", "x", "y", "to_node", "to_x", "to_y", "closed", "conductor"]


def _run_walk():
    """Edges of one run, which is put in order at its end."""
    edges: dict[int, tuple] = {}

    def ordered_() -> list[tuple]:
        leads, leaving = {}, {}
        for row, (_, _, _, a, b, *_, joint_a, joint_b) in edges.items():
            leads[2 * row], leads[2 * row + 1] = (b, joint_b), (a, joint_a)
            for dart, at, joint in ((2 * row, a, joint_a), (2 * row + 1, b, joint_b)):
                if joint:
                    leaving.setdefault(at, []).append(dart)
        # a dart's next one leaves the joint that it leads to by the other edge
        after = {d: next((o for o in leaving[at] if o != d ^ 1), d) if joint else None for d, (at, joint) in leads.items()}
        last, box = [d for d in leads if after[d] is None], False
        if not last:  # a loop is cut at its least node
            low, box = min(at for at, _ in leads.values()), True
            last = [d for d, (at, _) in leads.items() if at == low]
        rank = lambda x: (x is not None, x)
        end = max(last, key=lambda d: (rank(leads[d][0]), rank(edges[d >> 1][1]), d))
        back = [end ^ 1]
        while len(back) < len(edges):
            back.append(after[back[-1]])
        made, start = [], leads[back[-1]][0]
        for place, d in enumerate(x ^ 1 for x in reversed(back)):
            page, edge, length, a, b, ax, ay, bx, by, _, _ = edges[d >> 1]
            one, two = ((a, ax, ay), (b, bx, by)) if d % 2 == 0 else ((b, bx, by), (a, ax, ay))
            made.append((page, end, place, edge, length, *one, *two, start == leads[end][0], not box))
        return made

    def step(row):
        if row is None:
            return ordered_()
        edges[row[1]] = row[2:]
        return []

    return step


def ordered(edges: DataFrame) -> DataFrame:
    """Each edge's place in its maximal run between nodes whose degree is not two.

    (page, run, place, edge, length, node, x, y, to_node, to_x, to_y, closed, conductor): run names the run, places count
    from 0, an edge leads from node to to_node.  A run starts at the lower of its end nodes; a loop through one junction
    at it, and a loop without any, which is a box and no conductor, at its least node, both with the lower edge.

    Edges that meet at a node of degree two are tied, and components of these ties are the runs.  A run of up to ``HELD``
    edges is put in order in the task that it is dealt to; longer ones are ranked in rounds (``_ordered``).
    """
    tables = Tables(edges.sparkSession)
    own = tables.cut(edges.withColumn("row", F.monotonically_increasing_id()), "own")
    side = lambda k, at: F.struct(F.lit(k).alias("way"), F.col(at).alias("node"))
    darts = own.select("page", "row", F.explode(F.array(side(0, "a"), side(1, "b"))).alias("d")).select("page", "d.node", (F.col("row") * 2 + F.col("d.way")).alias("dart")).filter("page IS NOT NULL AND node IS NOT NULL")
    joints = darts.groupBy("page", "node").agg(F.count("*").alias("degree"), F.min("dart").alias("one"), F.max("dart").alias("two")).filter("degree = 2")
    joints = tables.cut(joints.select("one", "two"), "joints")
    row = lambda c: F.shiftright(c, 1)
    found = components(joints.select(row("one").alias("a"), row("two").alias("b")), tables)
    with small_tasks(edges.sparkSession):
        at = joints.select(F.explode(F.array("one", "two")).alias("dart")).groupBy(row("dart").alias("row")).agg(F.bool_or(F.col("dart") % 2 == 0).alias("joint_a"), F.bool_or(F.col("dart") % 2 == 1).alias("joint_b"))
        no = F.lit(False)
        tied = own.join(at, "row", "left").join(found.withColumnRenamed("vertex", "row"), "row", "left")
        columns = ["row", "page", "edge", "length", "a", "b", "ax", "ay", "bx", "by"]
        tied = tables.cut(tied.select(F.coalesce("component", "row").alias("of"), *columns, F.coalesce("joint_a", no).alias("joint_a"), F.coalesce("joint_b", no).alias("joint_b")), "tied")
        large, n = tables.counted(found.groupBy("component").count().filter(F.col("count") >= HELD).select(F.col("component").alias("of")), "large", F.lit(True))
        small = tied.join(large, "of", "left_anti") if n else tied
        kind = {f.name: f.dataType for f in own.schema}
        of = {"node": "a", "x": "ax", "y": "ay", "to_node": "a", "to_x": "ax", "to_y": "ay", "page": "page", "edge": "edge", "length": "length"}
        schema = StructType()
        for name in PLACED:
            schema = schema.add(name, kind[of[name]] if name in of else "boolean" if name in ("closed", "conductor") else "long")
        out = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
        placed = walk(small, ["of"], [], _run_walk, schema, out)
        if n:
            placed = placed.union(_ordered(tied.join(large, "of", "left_semi").drop("of"), tables))
        placed = tables.cut(placed, "placed")
    tables.drop(*[name for name in list(tables.paths) if name != "placed"])
    return placed


def _ordered(own: DataFrame, tables: Tables) -> DataFrame:
    """``ordered`` for runs of any length, whose edges know by joint_a and joint_b which ends are nodes of degree two.

    An edge is two darts, one each way; a dart's next one leaves the node of degree two that it leads to.  Lists of darts
    are ranked by pointer doubling, so rounds grow with the logarithm of the longest run and no task holds a run.
    """
    side = lambda k, a, b, joint: F.struct(F.lit(k).alias("way"), F.col(a).alias("from"), F.col(b).alias("node"), F.col(joint).alias("joint"))
    darts = own.select("page", "edge", "row", F.explode(F.array(side(0, "a", "b", "joint_b"), side(1, "b", "a", "joint_a"))).alias("d")).select("page", "edge", (F.col("row") * 2 + F.col("d.way")).alias("dart"), "d.from", "d.node", "d.joint")
    # at a node of degree two, the dart that leaves by the other edge
    leaving = darts.groupBy("page", F.col("from").alias("node")).agg(F.min("dart").alias("one"), F.max("dart").alias("two"))
    back = F.col("dart").bitwiseXOR(F.lit(1).cast("long"))
    led = darts.join(leaving, ["page", "node"], "left")
    darts = tables.cut(led.select("page", "edge", "dart", "from", "node", F.when(F.col("joint"), F.when(F.col("one") == back, F.col("two")).otherwise(F.col("one"))).alias("next")), "darts")
    ended, loops = _ranked(darts, tables, "open")
    # a loop is cut at its least node and ranked once more
    opened = tables.cut(darts.join(loops, "dart").select("dart", F.when(F.col("node") != F.col("low"), F.col("next")).alias("next"), "node"), "opened")
    around, _ = _ranked(opened, tables, "loops")
    ranks = ended.withColumn("box", F.lit(False)).union(around.withColumn("box", F.lit(True)))
    final = darts.select(F.col("dart").alias("last"), F.struct(F.col("node"), F.col("edge"), F.col("dart")).alias("final"))
    found = darts.select("page", "dart", "from", "node").join(ranks, "dart").join(final, "last")
    # of the two lists of a run, the one that ends at the higher node, or by the higher edge
    one = found.withColumn("row", F.shiftright("dart", 1)).groupBy("row").agg(F.max(F.struct("final", "dart", "from", "node", "hops", "box")).alias("d")).select("row", "d.*")
    one = tables.cut(one.withColumn("run", F.col("final.dart")), "one")
    runs = one.groupBy("run").agg(F.max("hops").alias("longest"), F.max(F.struct("hops", "from")).alias("start"), F.first("final.node").alias("end"))
    placed = own.join(one, "row").join(runs, "run")
    ahead = F.col("from") == F.col("a")
    at = lambda a, b, name: F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(name)
    placed = placed.select(
        "page", "run", (F.col("longest") - F.col("hops")).cast("long").alias("place"), "edge", "length", F.col("from").alias("node"), at("ax", "bx", "x"), at("ay", "by", "y"),
        F.col("node").alias("to_node"), at("bx", "ax", "to_x"), at("by", "ay", "to_y"), (F.col("start.from") == F.col("end")).alias("closed"), (~F.col("box")).alias("conductor"),
    )
    return placed.select(*PLACED)


def contract(edges: DataFrame) -> DataFrame:
    """Maximal runs between nodes whose degree is not two: (page, run, first_edge, points, node_ids, length, segment_count, closed, conductor).

    The runs of ``ordered``, each as one row; where a run may be beyond one row, take the rows of ``ordered``.
    """
    each = ordered(edges).groupBy("page", "run").agg(
        F.min("edge").alias("first_edge"), F.array_sort(F.collect_list(F.struct("place", "node", "x", "y"))).alias("steps"), F.max(F.struct("place", "to_node", "to_x", "to_y")).alias("end"),
        F.sum("length").alias("length"), F.count("*").cast("int").alias("segment_count"), F.first("closed").alias("closed"), F.first("conductor").alias("conductor"),
    )
    points = F.array_append(F.transform("steps", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))), F.struct(F.col("end.to_x").alias("x"), F.col("end.to_y").alias("y")))
    nodes = F.array_append(F.transform("steps", lambda s: s["node"]), F.col("end.to_node"))
    return each.select("page", "run", "first_edge", points.alias("points"), nodes.alias("node_ids"), "length", "segment_count", "closed", "conductor")


def glyph_clusters(strokes: DataFrame, prm: Params = Params()) -> DataFrame:
    """Boxes of strokes (page, stroke, x0, y0, x1, y1) whose ends lie in the same or adjoining grid cells."""
    point = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))))
    cell = lambda c: F.floor(F.col(c) / prm.glyph_cell)
    held = strokes.select("page", "stroke", point.alias("p")).select("page", "stroke", cell("p.x").alias("cx"), cell("p.y").alias("cy")).distinct()
    # cells, not strokes, are joined with their neighbours; a stroke is tied to its cells
    cells = held.select("page", "cx", "cy").distinct()
    step = F.sequence(F.lit(-1), F.lit(1))
    near = cells.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).filter("(dx, dy) > (0, 0)").select("page", F.col("cx").alias("ox"), F.col("cy").alias("oy"), (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    key = lambda x, y: F.xxhash64(F.lit("cell"), "page", x, y)
    links = near.join(cells, ["page", "cx", "cy"]).select(key("ox", "oy").alias("a"), key("cx", "cy").alias("b"))
    ties = held.select(key("cx", "cy").alias("a"), F.xxhash64(F.lit("stroke"), "page", "stroke").alias("b"))
    found = components(links.union(ties))
    own = strokes.withColumn("id", F.xxhash64(F.lit("stroke"), "page", "stroke")).join(found, F.col("vertex") == F.col("id"), "left").withColumn("cluster", F.coalesce("component", "id"))
    box = own.groupBy("page", "cluster").agg(F.min(F.least("x0", "x1")).alias("x0"), F.min(F.least("y0", "y1")).alias("y0"), F.max(F.greatest("x0", "x1")).alias("x1"), F.max(F.greatest("y0", "y1")).alias("y1"), F.count("*").cast("int").alias("strokes"), F.min("stroke").alias("first_stroke"))
    return box


def nets(conductors: DataFrame) -> DataFrame:
    """Nets of conductors (page, id, end_nodes array<long>, net_label): joined by shared end nodes and equal labels.

    A net has the label that most of its conductors have, ties by the first conductor.  All nets are numbered by their
    first conductor, and those without a label are named by that number.
    """
    me = F.xxhash64(F.lit("c"), "page", "id")
    by_node = conductors.select(me.alias("a"), F.explode("end_nodes").alias("n"), "page").select("a", F.xxhash64(F.lit("n"), "page", "n").alias("b"))
    by_label = conductors.filter("net_label IS NOT NULL").select(me.alias("a"), F.xxhash64(F.lit("l"), "page", "net_label").alias("b"))
    found = components(by_node.union(by_label))
    named = conductors.withColumn("me", me).join(found, F.col("vertex") == F.col("me"), "left").withColumn("net", F.coalesce("component", "me"))
    labels = named.filter("net_label IS NOT NULL").groupBy("page", "net", "net_label").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    mode = labels.groupBy("page", "net").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "net_label")).alias("m"), F.array_sort(F.collect_set("net_label")).alias("labels_seen"))
    rolled = named.groupBy("page", "net").agg(F.array_sort(F.collect_list("id")).alias("member_conductors"), F.count("*").cast("int").alias("conductor_count"), F.min("id").alias("first"))
    both = rolled.join(mode, ["page", "net"], "left").withColumn("labelled", F.col("m").isNotNull())
    number = F.row_number().over(Window.partitionBy("page").orderBy("first"))
    return both.select(
        "page", F.coalesce("m.net_label", F.format_string("NET-UNLABELLED-%03d", number)).alias("id"), F.coalesce("labels_seen", F.array().cast("array<string>")).alias("labels_seen"),
        "member_conductors", "conductor_count", "labelled", (F.size(F.coalesce("labels_seen", F.array().cast("array<string>"))) > 1).alias("conflicting_labels"),
    )
