"""The plant's rows are made once, and its edges do without the members of nets."""

from __future__ import annotations

from wireloom.plans import netlist
from wireloom.sources import plant

SMALL = "/root/testdata/sf0.001"


def test_rows_are_read_once_and_edges_list_no_members(spark):
    made = netlist.derive(netlist.qualified(plant.authored(spark, SMALL)))
    plan = lambda name: made[name]._jdf.queryExecution().optimizedPlan().toString()
    files = lambda name: " ".join(made[name].inputFiles())
    assert all("lineitem" not in files(name) and "plant-items" in files(name) for name in ("terminals", "wires", "relationships"))
    assert plan("relationships").count("collect_list") == 1  # of the subsystems
    assert plan("terminals").count("Join") == plan("wires").count("Join") == 0
