"""Netlist operators against plain Python on small inputs."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from wireloom.operators.components import components
from wireloom.operators.lines import gap_islands
from wireloom.operators.spatial import band_join, nearest
from wireloom.streaming import events


def test_components_of_paths_stars_and_repeats(spark):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1200)] + [(rnd.randrange(5000, 5400), rnd.randrange(5000, 5400)) for _ in range(150)]
    edges += [(7, 7), (None, 3), (3, None), *edges[:20]]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in parent if root(v) != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_band_join_is_overlap(spark):
    rnd = random.Random(5)
    left = [(k, rnd.randrange(3), float(s := rnd.randrange(100)), float(s + rnd.randrange(30))) for k in range(60)] + [(99, 1, None, 4.0)]
    right = [(k, rnd.randrange(3), float(s := rnd.randrange(100)), float(s + rnd.randrange(30))) for k in range(60)]
    got = band_join(spark.createDataFrame(left, "a long, page int, l0 double, l1 double"), spark.createDataFrame(right, "b long, page int, r0 double, r1 double"), ["page"], ("l0", "l1"), ("r0", "r1"), 7.0)
    want = Counter((a, b) for a, p, l0, l1 in left if l0 is not None for b, q, r0, r1 in right if p == q and l0 <= r1 and r0 <= l1)
    assert Counter((r.a, r.b) for r in got.collect()) == want


def test_nearest_within_radius_and_ties(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 100.0, 100.0), (2, 3, 0.0, 0.0)], "page int, id long, x double, y double")
    marks = spark.createDataFrame([(1, "b", 3.0, 4.0), (1, "a", -3.0, 4.0), (1, "c", 0.0, 7.0)], "page int, symbol string, sx double, sy double")
    got = nearest(points, marks, ["page"], ["id"], ("x", "y"), ("sx", "sy"), "symbol", "symbol", 7.0)
    assert {r.id: (r.nearest_id, r.nearest_distance) for r in got.collect()} == {1: ("a", 5.0), 2: (None, None), 3: (None, None)}


def test_gap_islands(spark):
    rows = [(1, 0, 0.0), (1, 1, 5.0), (1, 2, 20.0), (2, 3, 1.0)]
    got = gap_islands(spark.createDataFrame(rows, "g int, id int, t double"), ["g"], "t", ["t", "id"], 5.0)
    assert {r.id: r.island for r in got.collect()} == {0: 1, 1: 1, 2: 2, 3: 1}


def test_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{source}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    got = events.windowed(events.stream(spark, str(tmp_path / "in")))
    events.run_once(got, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    done = spark.read.schema(got.schema).parquet(str(tmp_path / "out"))
    want = {(r.window_start, r.event_type): r.n for r in events.windowed(batch).collect()}
    closed = {(r.window_start, r.event_type): r.n for r in done.collect()}
    assert closed and all(want[k] == n for k, n in closed.items())
    assert len(closed) > 0.9 * len(want)  # the last windows stay open
