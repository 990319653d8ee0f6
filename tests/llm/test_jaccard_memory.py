"""What a task of the Jaccard join holds at once."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from wireloom.llm import jaccard_join


def test_keys_are_dealt_in_portions_of_bounded_bytes(spark):
    """One partition with thrice the bytes that are dealt at once, all of one bucket: rows stay small, and no key is lost."""
    size = jaccard_join.KEY_BYTES * 1000
    docs = 3 * jaccard_join.DEALT_BYTES // size
    rows = [(k, bytearray(os.urandom(size))) for k in range(docs)]
    keyed = spark.createDataFrame(rows, "doc_id long, keys binary").coalesce(1)
    dealt = jaccard_join._dealt(keyed, 1).filter("bucket >= 0").agg(F.max(F.octet_length("keys")), F.sum(F.octet_length("keys"))).first()
    assert dealt[0] <= jaccard_join.DEALT_BYTES
    assert dealt[1] == docs * size


def test_small_batches_end_with_the_join(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    joined = jaccard_join._joined
    jaccard_join._joined = lambda *a: seen.append(spark.conf.get(name)) or joined(*a)
    try:
        got = sorted(tuple(r) for r in jaccard_join.join(docs).collect())
    finally:
        jaccard_join._joined = joined
    assert got == [(1, 2, 1), (2, 2, 1)]
    assert seen == ["2048"] and spark.conf.get(name) == before
