"""Several sheets, documents that read back, geometry that is pruned, and tables in the shared folder."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wireloom import shared
from wireloom.operators.components import components
from wireloom.plans import extract, kg, netlist, query
from wireloom.plans.queries import _two_sheets
from wireloom.sources import files, sheet


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_equal_ids_of_two_sheets_never_meet(spark):
    n = netlist.derive(netlist.qualified(_two_sheets(spark)))
    assert rows(n["nets"], "id", F.array_join("member_terminals", " ")) == [(f"{d}#N1", f"{d}#R1:1 {d}#R1:2") for d in "AB"]
    assert rows(query.pin_out(n, "A#R1"), "terminal", "other") == [("A#R1:1", "A#R1:2"), ("A#R1:2", "A#R1:1")]
    assert rows(netlist.completeness(n), "check", "id") == []
    graph = kg.build(n)
    assert kg.validate(graph).filter("check <> 'short description'").isEmpty()
    assert {("A::entity::A", 0), ("B::entity::B", 0), ("B::entity::B#R1", 1)} <= set(rows(graph["chunks"], "source_id", "chunk_order_index"))
    plain = kg.validate(kg.build(netlist.derive(_two_sheets(spark))))
    assert {r.id for r in plain.filter("check = 'duplicate entity name'").collect()} == {"R1", "N1", "R1:1", "R1:2"}


def test_tables_without_a_number_need_one_drawing(spark):
    two = _two_sheets(spark)
    with pytest.raises(ValueError, match="drawing_no"):
        netlist.sheeted({**two, "nets": two["nets"].drop("drawing_no")})


def test_netlist_documents_read_back(spark, tmp_path):
    example = netlist.derive(sheet.authored(spark))
    both = netlist.derive(_two_sheets(spark))
    for name, made in (("one", example), ("two", both)):
        files.write_netlist(made, str(tmp_path / name))
        back = files.read_netlist(spark, str(tmp_path / name), lines=True)
        for table in ("terminals", "nets", "wires", "cables", "relationships"):
            want = netlist.sheeted(made)[table]
            columns = ["drawing_no", *[c for c in want.columns if c in back[table].columns and c not in ("drawing_no", "ord", "section", "properties")]]
            assert rows(back[table], *columns) == rows(want, *columns), (name, table)
        assert rows(back["components"], "drawing_no", "id", "zone") == rows(netlist.sheeted(made)["components"], "drawing_no", "id", "zone" if "zone" in made["components"].columns else F.lit(None).cast("string").alias("zone"))
    files_ = [p.read_text() for p in (tmp_path / "two").glob("part-*")]
    assert sum(len(t.splitlines()) for t in files_) == 2


def test_geometry_is_pruned_by_page(spark, tmp_path):
    marks = spark.createDataFrame([(p, k, 0, "S", "l", 0.0, 10.0 * k, 100.0, 10.0 * k, 0.0, 10.0 * k, 100.0, 10.0 * k) for p in (1, 2) for k in range(3)], "page int, group_id long, item int, layer string, op string, x0 double, y0 double, x1 double, y1 double, group_x0 double, group_y0 double, group_x1 double, group_y1 double")
    boxes = spark.createDataFrame([(1, 20.0, 1.0, 30.0, 5.0, "h", "110")], "page int, x0 double, y0 double, x1 double, y1 double, orientation string, raw string")
    found = extract.extract(marks, boxes)
    counts = {(r.page, r.name): r.n for r in found["counters"].collect()}
    assert counts[1, "conductors"] == 3 and counts[1, "conductors_with_net_label"] == 1 and counts[2, "nets_labelled"] == 0 and counts[1, "labels_read"] == 1
    assert rows(found["nets"].filter("page = 1 AND NOT labelled"), "id") == [("NET-UNLABELLED-001",), ("NET-UNLABELLED-003",)]  # the labelled net is the second
    files.write_geometry({k: found[k] for k in ("conductors", "counters", "params")}, str(tmp_path / "all"))
    page = files.read_geometry(spark, str(tmp_path / "all"), "conductors", 2)
    assert page.count() == 3 and "PartitionFilters: [isnotnull(page" in page._jdf.queryExecution().toString()
    files.write_geometry(found, str(tmp_path / "counts"), only_counts=True)
    assert sorted(p.name for p in (tmp_path / "counts").iterdir()) == ["counters", "params"]


def test_shared_folder_is_asked_for_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, default=None: None, set=lambda key, value: None)
    for master, good in (("spark://host:7077", False), ("yarn", False), ("local-cluster[2,1,1024]", False), ("local[4]", True)):
        session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
        if good:
            assert shared.shared_dir(session).startswith("file:///")
        else:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                shared.shared_dir(session)


def test_rounds_leave_one_table(spark):
    folder = Path(shared.run_dir(spark).removeprefix("file://"))
    before = {p for p in folder.rglob("*.parquet")} if folder.exists() else set()
    found = components(spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long"))
    assert found.count() == 40
    assert len({p.parent for p in set(folder.rglob("*.parquet")) - before}) == 1


def test_numbers_over_ranges(spark):
    made = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.when(F.col("id") % 50 > 0, F.col("id").cast("string")).alias("s")).repartition(7)
    got = shared.numbered(made, ["k"], "place").collect()
    assert [r.place for r in sorted(got, key=lambda r: r.k)] == list(range(5000))
