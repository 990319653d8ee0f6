"""Greedy matching against a plain walk: random candidates and chains in which each pair waits for the one before."""

from __future__ import annotations

import random

import pytest

from wireloom.operators import matching
from wireloom.operators.matching import greedy_match
from wireloom.shared import run_dir

SCHEMA = "a long, b long, gap long, note string"


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def walked(rows):
    used, out = set(), []
    for a, b, gap, note in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[2], r[0], r[1])):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out.append((a, b, gap, note))
    return sorted(out)


def matched(spark, rows):
    return sorted(tuple(r) for r in greedy_match(spark.createDataFrame(rows, SCHEMA), ["a"], ["b"], ["gap", "a", "b"]).collect())


def test_chain_of_ten_thousand(few):
    spark = few
    n = 5_000  # candidates of two each: a1-b1, a2-b1, a2-b2, a3-b2, ..., each nearer than the next
    rows = [(k + j, k, 2 * k + j, "c") for k in range(n) for j in range(2)]
    random.Random(1).shuffle(rows)
    assert matched(spark, rows) == walked(rows)


def test_both_sides_share_a_column(few, monkeypatch):
    monkeypatch.setattr(matching, "ROUNDS", 0)
    rows = [(p, k + j, k, 2 * k + j) for p in range(3) for k in range(40) for j in range(2)]
    made = greedy_match(few.createDataFrame(rows, "page long, a long, b long, gap long"), ["page", "a"], ["page", "b"], ["gap", "page", "a"])
    assert sorted((r.page, r.a, r.b) for r in made.collect()) == [(p, k, k) for p in range(3) for k in range(40)]


def test_random_candidates(few, monkeypatch):
    spark = few
    monkeypatch.setattr(matching, "ROUNDS", 1)
    draw = random.Random(2)
    rows = list({(draw.randrange(300), draw.randrange(300)): None for _ in range(1_500)})
    rows = [(a, b, draw.randrange(40), "r") for a, b in rows] + [(None, 1, 0, "no side"), (1, None, 0, "no side")]
    rows += [(1_000, 500 + k, k, "hub") for k in range(500)]
    assert matched(spark, rows) == walked(rows)


def test_empty_and_what_stays(few):
    spark = few
    assert matched(spark, []) == []
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = fs.Path(run_dir(spark))
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def tables():
        return {f.getPath().toString() for d in system.listStatus(place) for f in system.listStatus(d.getPath())}

    before = tables()
    rows = [(k + j, k, 2 * k + j, "c") for k in range(60) for j in range(2)]
    assert matched(spark, rows) == walked(rows)
    assert len(tables() - before) == 1  # the matching itself


def test_first_choices_read_what_is_open_twice(few, monkeypatch):
    """Once for each side: the rows of the first choices are not looked up in the whole again."""
    plans, cut = [], matching.Tables.cut
    monkeypatch.setattr(matching.Tables, "cut", lambda self, df, what, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if what == "taken-0" else None, cut(self, df, what, *a))[1])
    rows = [(1, 1, 2, "x"), (1, 2, 1, "y"), (2, 2, 3, "z"), (2, 1, 4, "w")]
    assert matched(few, rows) == walked(rows)
    assert plans[0].count("FileScan parquet") == 2
