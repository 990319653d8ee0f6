"""Bands, text lines and snapped nodes of a page against the plain walks over a whole page."""

from __future__ import annotations

import random

import pytest

from wireloom.operators import graph, lines

GLYPHS = "page int, id string, x0 double, y0 double, x1 double, y1 double"


def plain_bands(rows, tol=2.5):
    out = {}
    for page in {r[0] for r in rows}:
        bands: list[list[float]] = []
        for r in sorted((r for r in rows if r[0] == page), key=lambda r: ((r[3] + r[5]) / 2, r[2], r[1])):
            y = (r[3] + r[5]) / 2
            k = next((k for k, b in enumerate(bands) if abs(y - b[0] / b[1]) < tol), len(bands))
            if k == len(bands):
                bands.append([0.0, 0])
            bands[k][0] += y
            bands[k][1] += 1
            out[r[1]] = k
    return out


def plain_lines(rows, band, gap=1.45):
    out = {}
    for key in {(r[0], band[r[1]]) for r in rows}:
        boxes: list[list] = []
        for _, _, x0, y0, x1, y1 in sorted((r for r in rows if (r[0], band[r[1]]) == key), key=lambda r: (r[2], r[1])):
            last = boxes[-1] if boxes else None
            if last and x0 - last[2] < gap * max(last[3] - last[1], y1 - y0, 3.0):
                boxes[-1] = [min(last[0], x0), min(last[1], y0), max(last[2], x1), max(last[3], y1), last[4] + 1]
            else:
                boxes.append([x0, y0, x1, y1, 1])
        out |= {(*key, k): tuple(b) for k, b in enumerate(boxes)}
    return out


def plain_snap(rows, tol=0.35):
    out = []
    for page in sorted({r[0] for r in rows}):
        nodes: list[tuple[float, float]] = []

        def node(x, y):
            for k, (nx, ny) in enumerate(nodes):
                if (nx - x) ** 2 + (ny - y) ** 2 <= tol * tol:
                    return k
            nodes.append((x, y))
            return len(nodes) - 1

        for r in sorted((r for r in rows if r[0] == page), key=lambda r: r[1]):
            a, b = node(r[2], r[3]), node(r[4], r[5])
            if a != b:
                out.append((page, r[1], a, b, *nodes[a], *nodes[b]))
    return sorted(out)


def test_bands_and_lines(spark):
    rnd = random.Random(11)
    rows = []
    for k in range(1500):
        page = rnd.choice([1, 1, 2])
        y = rnd.choice([rnd.uniform(0, 60), rnd.randrange(100, 400, 5) + rnd.choice([0.0, 0.5, 2.5])])  # dense, and with gaps of the tolerance
        x, w, h = rnd.uniform(0, 600), rnd.uniform(1, 6), rnd.uniform(1, 9)
        rows.append((page, f"{k:05d}", x, y, x + w, y + h if y < 60 else y + 4))
    band = plain_bands(rows)
    banded = lines.baseline_bands(spark.createDataFrame(rows, GLYPHS))
    assert {r.id: r.band for r in banded.collect()} == band
    got = {(r.page, r.band, r.line): (r.x0, r.y0, r.x1, r.y1, r.glyphs) for r in lines.text_lines(banded).collect()}
    assert got == plain_lines(rows, band)


def test_snapped_nodes(spark):
    rnd = random.Random(12)
    rows = []
    for k in range(400):
        page = rnd.choice([1, 1, 2])
        at = lambda: (rnd.choice([rnd.uniform(0, 4), rnd.randrange(10, 200, 10) + rnd.uniform(-0.3, 0.3)]), rnd.choice([rnd.uniform(0, 4), float(rnd.randrange(10, 60, 10))]))
        rows.append((page, 1000 - k, *at(), *at()))
    rows += [(3, k, 0.2 * k, 0.0, 0.2 * k + 0.2, 0.0) for k in range(100)]  # a chain of steps below the tolerance
    got = graph.snap_nodes(spark.createDataFrame(rows, "page int, seg long, x0 double, y0 double, x1 double, y1 double")).collect()
    want = plain_snap(rows)
    assert sorted((r.page, r.edge, r.a, r.b, r.ax, r.ay, r.bx, r.by) for r in got) == want
    assert all(r.length == pytest.approx(((r.ax - r.bx) ** 2 + (r.ay - r.by) ** 2) ** 0.5) for r in got)


@pytest.mark.parametrize("name", ["bands", "lines", "nodes"])
def test_no_page_in_one_group(spark, name):
    """No operator gathers a page: neither a pandas group nor a collected list is in its plan."""
    glyphs = spark.createDataFrame([(1, "a", 0.0, 0.0, 1.0, 1.0)], GLYPHS)
    segments = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0)], "page int, seg long, x0 double, y0 double, x1 double, y1 double")
    df = {"bands": lambda: lines.baseline_bands(glyphs), "lines": lambda: lines.text_lines(lines.baseline_bands(glyphs)), "nodes": lambda: graph.snap_nodes(segments)}[name]()
    plan = df._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "collect_list" not in plan
