"""Nets of whole tables against a plain union-find."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from wireloom.operators import components as components_
from wireloom.plans.queries import QUERIES
from wireloom.sources import bridge

SMALL = "/root/testdata/sf0.001"


def union_find(edges) -> dict[int, int]:
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {v: root(v) for v in list(parent)}


def terminals(spark, sf_dir) -> list[tuple[int, int]]:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    return [(r.l_orderkey, -1 - r.l_partkey) for r in rows if r.l_orderkey is not None and r.l_partkey is not None]


def found(df) -> dict[int, int]:
    rows = df.collect()
    got = {r.vertex: r.component for r in rows}
    assert len(got) == len(rows)
    return got


def test_nets_of_light_items_hubs_and_chains(spark, tmp_path):
    chain = [(k + d, 500 + k) for k in range(60) for d in (0, 1)]  # orders 0 to 60 by parts 500 to 559
    hub = [(100 + k, 900) for k in range(300)]
    rows = [*chain, *hub, (1000, 0), (1001, 0), (1000, 0), (2000, 7), (None, 8), (2001, None)]
    items = [(o, p, 1.0, 0.0) for o, p in rows]  # none has a large quantity or discount
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = found(QUERIES["nets_whole"](spark, str(tmp_path)))
    assert got == union_find(terminals(spark, tmp_path))
    assert len(set(got.values())) == 4 and got[0] != got[-1]  # order 0 and part 0 stay apart


def test_flagship_covers_the_table(spark):
    assert found(entry.entry(spark)) == union_find(terminals(spark, entry.SMALL))


def test_terminals_are_dealt_in_bounded_tasks(spark, monkeypatch):
    whole = {tuple(r) for r in bridge.terminals(spark, SMALL).collect()}
    monkeypatch.setattr(bridge, "ROWS", 100)
    dealt = bridge.terminals(spark, SMALL)
    assert dealt.rdd.getNumPartitions() >= spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 100
    assert {tuple(r) for r in dealt.collect()} == whole


@pytest.mark.parametrize("hubs", [1, 4, 10**9])
def test_hubs_are_looked_up_apart(spark, monkeypatch, hubs):
    monkeypatch.setattr(components_, "HUBS", hubs)
    pairs = [(k, 0) for k in range(1, 60)] + [(k, 7) for k in range(60, 90)] + [(200, 100), (201, 100), (202, 201)]
    df = spark.createDataFrame(pairs, "a long, b long")
    around = {}
    for a, b in pairs:
        around.setdefault(a, {a}).add(b)
        around.setdefault(b, {b}).add(a)
    want = {(w, min(near)) for v, near in around.items() for w in near if w > v}
    got = [tuple(r) for r in components_._large(df, len(pairs)).collect()]
    assert set(got) == want and len(got) == len(want)
