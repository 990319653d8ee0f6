"""A graph changes at once or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wireloom.plans import kg
from wireloom.sources import files, snapshots


def graph(spark, names, says="a part of the sheet that is described here"):
    chunks = [(says, f"S::{n}", "f", k) for k, n in enumerate(names)]
    ties = [(a, b, "PART_OF", says, "part of", f"S::rel::{a}{b}") for a, b in zip(names, names[1:], strict=False)]
    return {
        "chunks": spark.createDataFrame(chunks + [(t[3], t[5], "f", 9) for t in ties], "content string, source_id string, file_path string, chunk_order_index int"),
        "entities": spark.createDataFrame([(n, "relay", says, f"S::{n}") for n in names], "entity_name string, entity_type string, description string, source_id string"),
        "relationships": spark.createDataFrame(ties, "src_id string, tgt_id string, type string, description string, keywords string, source_id string"),
    }


def shown(spark, path):
    read = files.read_graph(spark, path)
    return {r.entity_name: r.description for r in read["entities"].collect()}, read["relationships"].count(), read["chunks"].count()


def test_commits_replace_upsert_and_survive_a_crash(spark, tmp_path):
    path, long, other = f"file://{tmp_path}/graph", "a part of the sheet that is described here", "another description that is long enough"
    assert kg.write(graph(spark, "AB"), path, dry_run=True).isEmpty() and snapshots.versions(spark, path) == []
    kg.write(graph(spark, "AB"), path)
    assert shown(spark, path) == ({"A": long, "B": long}, 1, 3)
    with pytest.raises(ValueError, match="holds a graph"):
        kg.write(graph(spark, "XY"), path)
    kg.write(graph(spark, "BC", other), path, mode="upsert")
    assert shown(spark, path) == ({"A": long, "B": other, "C": other}, 2, 5)
    with pytest.raises(ValueError, match="problems"):
        kg.write(graph(spark, "D", "short"), path, mode="upsert")
    dying = graph(spark, "PQ")
    dying["relationships"] = dying["relationships"].withColumn("keywords", F.when(F.col("src_id") == "P", F.raise_error(F.lit("lost"))))
    before = shown(spark, path)
    with pytest.raises(Exception, match="lost"):
        snapshots.commit(spark, dying, path)  # its chunks and entities are written, then it dies
    assert shown(spark, path) == before and len(list((tmp_path / "graph/snapshots").iterdir())) == 3
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, graph(spark, "PQ"), path, base=1)
    assert shown(spark, path) == before and snapshots.versions(spark, path) == [1, 2]
    kg.write(graph(spark, "Z"), path, mode="overwrite")
    assert shown(spark, path)[0] == {"Z": long} and snapshots.tables(spark, path, 1)["entities"].count() == 2
    snapshots.vacuum(spark, path)
    assert snapshots.versions(spark, path) == [3] and len(list((tmp_path / "graph/snapshots").iterdir())) == 1 and shown(spark, path)[0] == {"Z": long}


def test_two_commits_of_one_base(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/graph"
    snapshots.commit(spark, graph(spark, "A"), path)
    monkeypatch.setattr(snapshots, "versions", lambda *a: [])  # as seen by a writer before the first commit was made
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, graph(spark, "B"), path)
    monkeypatch.undo()
    assert shown(spark, path)[0].keys() == {"A"}
