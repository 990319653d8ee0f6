"""Greedy exclusive matching: mutual first choices, then walks over conflict components of growing prefixes."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Tables, numbered, walk
from .components import components

#: Rounds of mutual first choices, and the shares of what is then left that are walked one after another.
ROUNDS = 3
PREFIXES = (0.125, 0.25, 0.5)
AT, IN = "wireloom_at", "wireloom_in"


def _walk(left: int) -> Callable:
    """The walk of one component: (component, place, left columns, right columns) give a place where both sides are free."""
    used: set[tuple] = set()

    def step(row: tuple | None) -> list[tuple]:
        if row is None:
            return []
        one, two = ("l", *row[2 : 2 + left]), ("r", *row[2 + left :])
        if one in used or two in used:
            return []
        used.update((one, two))
        return [(row[1],)]

    return step


def _walked(some: DataFrame, left: list[str], right: list[str], tables: Tables) -> DataFrame:
    """The places that a walk over these candidates takes; candidates that share no side, even by others, never meet."""
    ends = some.select("*", F.xxhash64(F.lit("l"), *left).alias("wireloom_a"), F.xxhash64(F.lit("r"), *right).alias("wireloom_b"))
    named = components(ends.select(F.col("wireloom_a").alias("a"), F.col("wireloom_b").alias("b")), tables)
    own = ends.join(named, F.col("vertex") == F.col("wireloom_a"), "left").select(F.coalesce("component", "wireloom_a").alias(IN), AT, *(F.col(c).alias(f"wireloom_{k}") for k, c in enumerate(left + right)))
    return walk(own, [IN], [AT], lambda: _walk(len(left)), f"{AT} long", pa.schema([(AT, pa.int64())]))


def greedy_match(candidates: DataFrame, left: list[str], right: list[str], order: list[str]) -> DataFrame:
    """The pairs that a walk over all candidates in ``order`` takes where both sides are still free.

    A pair that is first on both sides is taken by the walk, so some rounds of such pairs, each followed by dropping what
    they claim, give part of the same matching.  What is left (long chains, in which each pair waits for the one before)
    is cut into prefixes of the order; within a prefix, candidates that share a side, directly or through others, are
    walked in one task over rows that Spark sorts, which holds the sides that are taken.  So the number of rounds is
    bounded, but for the logarithm of the components'.  Ties of ``order`` fall to either; a null side matches nothing.
    """
    tables = Tables(candidates.sparkSession)
    every = tables.cut(numbered(candidates.dropna(subset=left + right), order, AT, tables), "every")
    tables.drop("ranged")
    sides = [AT, *dict.fromkeys(left + right)]
    open_, taken = every.select(*sides), []

    def claim(first: DataFrame, beyond: int | None = None) -> int:
        """Keep the pairs found, drop what they claim, and count what stays open."""
        nonlocal open_
        first = tables.cut(first.select(*sides), f"taken-{len(taken)}")
        taken.append(first)
        rest = open_ if beyond is None else open_.filter(F.col(AT) > beyond)
        open_, n = tables.counted(rest.join(first.select(*left), left, "left_anti").join(first.select(*right), right, "left_anti"), "open", F.lit(True))
        return n

    n = 1
    for _ in range(ROUNDS):
        if n:
            # places are unique, so the first of a left side brings its right one along, and only firsts are dealt again
            others = [c for c in sides if c not in (AT, *left)]
            a = open_.groupBy(*left).agg(F.min(F.struct(AT, *others)).alias("wireloom_first")).select(*left, "wireloom_first.*")
            b = open_.groupBy(*right).agg(F.min(AT).alias(AT)).select(AT)
            n = claim(a.join(b, AT, "left_semi"))
    bounds = [int(x) for x in open_.approxQuantile(AT, list(PREFIXES), 0.01)] if n else []
    for bound in bounds:
        some = tables.cut(open_.filter(F.col(AT) <= bound), "prefix")
        n = claim(some.join(_walked(some, left, right, tables), AT, "left_semi"), bound)
    if n:
        claim(open_.join(_walked(open_, left, right, tables), AT, "left_semi"))
    tables.drop("open", "prefix", "stars")
    found = taken[0]
    for more in taken[1:]:
        found = found.union(more)
    made = tables.cut(every.join(found.select(AT), AT, "left_semi").select(*candidates.columns), "matching")
    tables.drop("every", *[f"taken-{k}" for k in range(len(taken))])
    return made
