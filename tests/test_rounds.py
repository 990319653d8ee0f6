"""Paths and relay logic that need more rounds than the example sheet."""

from __future__ import annotations

import pytest

from wireloom.operators.paths import trace
from wireloom.plans.simulate import simulate


@pytest.fixture
def small(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_chain_with_a_mesh(small):
    chain = [(f"v{k}", f"v{k + 1}", f"s{k:02d}") for k in range(30)]
    mesh = [("v30", "x", "m2"), ("v30", "y", "m1"), ("v30", "z", "m1"), ("x", "end", "a"), ("y", "end", "c"), ("z", "end", "b"), ("x", "y", "q"), ("far", "off", "t")]
    edges = small.createDataFrame(chain + mesh, "a string, b string, via string")
    got = trace(edges, "v0", "end").collect()
    assert [(r.vertices, r.via) for r in got] == [([f"v{k}" for k in range(31)] + ["z", "end"], [f"s{k:02d}" for k in range(30)] + ["m1", "b"])]
    assert trace(edges, "v0", "off").isEmpty()


def test_deep_cascade_and_buzzer(small):
    n = 13
    classes = [(f"R{k}", "relay") for k in range(n)] + [("B", "relay"), ("P", "push_button")]
    pins = []
    for k in range(n):  # each coil is fed by the contact of the relay before
        pins += [(f"R{k}", "A1", "24E-1" if k == 0 else f"N{k}"), (f"R{k}", "A2", "0V"), (f"R{k}", "11", "24E-1"), (f"R{k}", "14", f"N{k + 1}")]
    pins += [("P", "1", "24E-1"), ("P", "4", "W"), ("B", "11", "W"), ("B", "12", "V"), ("B", "A1", "V"), ("B", "A2", "0V")]  # a coil that opens its own feed
    made = {
        "components": small.createDataFrame(classes, "id string, class string"),
        "terminals": small.createDataFrame([(f"{c}:{p}", c, net) for c, p, net in pins], "id string, parent_component string, net string"),
        "nets": small.createDataFrame([(x,) for x in sorted({p[2] for p in pins})], "id string"),
    }
    out = simulate(made, small.createDataFrame([(0, "P", False), (1, "P", True)], "scenario long, component string, closed boolean"))
    assert {r.component for r in out["coils"].collect() if r.scenario == 0} == {f"R{k}" for k in range(n)}
    assert [r.scenario for r in out["oscillating"].collect()] == [1] and not out["settled"]
