"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, scratch, shared_dir

__all__ = ["WORD", "cut", "let", "scratch", "shared_dir", "table", "text_bytes"]

#: A word is a run of anything but blank, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes in the text columns: a scan of these, one number to the driver."""
    total = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns[1:]), F.coalesce(F.octet_length(columns[0]), F.lit(0)))
    return df.agg(F.sum(total.cast("long"))).first()[0] or 0
