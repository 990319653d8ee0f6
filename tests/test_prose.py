"""Sentences of descriptions against plain patterns, and what they cost."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import functions as F

from wireloom.functions import text as X
from wireloom.plans import kg, netlist
from wireloom.sources import plant

SMALL = "/root/testdata/sf0.001"
PARTS = [None, "", " ", "a", ".", "..", " a. ", "\tb\n.\r", "c.\x0b.", ". d", "e.  .", "f. . g", "x ", "h. .. i.", "É. \f. "]


def bare(part) -> str:
    return re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z", "", part or "")


def said(parts) -> str:
    kept = [p for p in map(bare, parts) if p]
    return re.sub(r"\.[ \t\n\x0b\f\r]*\.([ \t\n\x0b\f\r]|\Z)", r".\1", " ".join(kept))


def test_sentences_of_odd_parts(spark):
    rows = list(itertools.product(PARTS, repeat=2))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", X.sentence(F.col("a"), F.col("b")).alias("said"), X.trimmed(F.col("a")).alias("trimmed"), X.clean(F.col("a")).alias("clean")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.said == said([r.a, r.b]), (r.a, r.b)
        assert r.trimmed == bare(r.a) and r.clean == (bare(r.a) or None)


def test_wires_keep_their_numbers(spark):
    rows = [(n, "a", "A#x" if n and n % 2 else "x") for n in (-7, 0, 5, 7, 42, 99, 100, 101, 999, 1000, 1234567890123)]
    df = spark.createDataFrame(rows, "ord long, a string, from_terminal string")
    for r in df.withColumn("id", netlist._wire_id(df)).collect():
        assert r.id == ("A#" if r.ord % 2 else "") + f"W{r.ord:03d}"


def test_prose_tries_few_patterns(spark):
    """A pattern for each text, not several for each of its parts: these took most of the time of ``plant_prose``."""
    made = netlist.derive(netlist.qualified(plant.authored(spark, SMALL)))
    plan = kg.build(made)["entities"].select("description")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 8  # components are two tables
    wires = made["wires"].select(kg.describe_wire(made["wires"]).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert wires.count("regexp_replace") == 1
