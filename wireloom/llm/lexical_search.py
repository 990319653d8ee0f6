"""Ranked lexical search: the documents that score highest for each item, by a blocked sparse matrix product.

Items are the rows of a sparse matrix of term multiplicities, which is multiplied with the term-document matrix of
integer impacts.  Documents come in blocks of bounded bytes; a block's matrix is made from its texts, and each item's
product row is merged from the matrix rows of its terms in one integer accumulator (Gustavson's way).  A task keeps the
best k of each item over its blocks, and these are reduced by item and salt, then by item.

Terms are runs of digits, letters and anything beyond ASCII, with A-Z in lower case.  N documents have a term; L is the
number of all terms, n of a document's, df the documents that hold a term, tf its occurrences there.
A term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); with m = 100 - B + (B * n * N) div L, a document scores the
sum of times * w * ((10^9 * tf) div (1000 * tf + 20 * m)) over an item's terms, in 64-bit integers.  times is the
term's multiplicity in the item, or 1 with ``once``.

Null and empty texts have no terms: such documents score nothing and such items have no rows.  Each row of either table
counts by itself, whatever its id; equal scores come by ascending doc_id, null last.  Items go through the driver in
blocks of at most ``ITEMS`` rows and ``ITEM_BYTES`` of text (one item at least), and each block scans all documents
twice, for the counts and for the scores.  Other columns are not read.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .words import gather, portions, terms

K = 50
B = 50
ITEMS, ITEM_BYTES = 4096, 2 << 20
#: Bytes of texts in one block of documents.
PORTION = 4 << 20
#: Parts into which an item's candidates are dealt before they meet.
SALTS = 64


class Items(NamedTuple):
    """A block of items: for each, its terms' places among the distinct terms of the block, and their multiplicities."""

    ids: list
    terms: pa.Array  # distinct terms, each with a blank
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray


def items_of(rows: list[tuple], once: bool) -> Items:
    """The multiplicity matrix of rows (id, text)."""
    split = terms(pa.array([text for _, text in rows], pa.large_string()))
    codes, distinct = split.codes()
    of = np.repeat(np.arange(len(rows)), np.diff(split.first))
    cell, times = np.unique(of * max(len(distinct), 1) + codes, return_counts=True)
    row, term = np.divmod(cell, max(len(distinct), 1))
    return Items([i for i, _ in rows], distinct, np.searchsorted(row, np.arange(len(rows) + 1)), term, np.ones_like(times) if once else times)


def item_blocks(items: DataFrame, once: bool) -> Iterator[Items]:
    rows, held = [], 0
    for item, text in items.toLocalIterator():
        size = len((text or "").encode())
        if rows and (len(rows) == ITEMS or held + size > ITEM_BYTES):
            yield items_of(rows, once)
            rows, held = [], 0
        rows.append((item, text))
        held += size
    if rows:
        yield items_of(rows, once)


class Matrix(NamedTuple):
    """The term-document matrix of a block: rows by term, with the number of terms of each document."""

    first: np.ndarray
    doc: np.ndarray
    tf: np.ndarray
    lengths: np.ndarray


def matrix(texts: pa.Array, wanted: pa.Array) -> Matrix:
    split = terms(texts)
    codes, distinct = split.codes()
    lengths = np.diff(split.first)
    if not len(codes):
        return Matrix(np.zeros(len(wanted) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), lengths)
    place = pc.fill_null(pc.index_in(distinct, value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = place[codes]
    of = np.repeat(np.arange(len(lengths)), lengths)[row >= 0]
    cell, tf = np.unique(row[row >= 0] * len(lengths) + of, return_counts=True)
    row, doc = np.divmod(cell, len(lengths))
    return Matrix(np.searchsorted(row, np.arange(len(wanted) + 1)), doc, tf, lengths)


class Counts(NamedTuple):
    documents: int
    all_terms: int
    df: np.ndarray


def counts(docs: DataFrame, wanted: pa.Array) -> Counts:
    """N, L and each wanted term's df over all of docs (text): one row for each term comes to the driver."""
    n = len(wanted)

    def count(batches):
        total = np.zeros(n + 2, np.int64)
        for part in portions(batches, 0, PORTION):
            made = matrix(part.column(0), wanted)
            total[:n] += np.diff(made.first)
            total[n:] += np.count_nonzero(made.lengths), made.lengths.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    total = np.zeros(n + 2, np.int64)
    for at, held in docs.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).toLocalIterator():
        total[at] = held
    return Counts(int(total[n]), int(total[n + 1]), total[:n])


def weights(seen: Counts) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * seen.documents + 2) / (2 * d + 1))) for d in seen.df.tolist()], np.int64)


def impacts(made: Matrix, seen: Counts, weight: np.ndarray) -> np.ndarray:
    """The block's values, term by term."""
    sizes, which = np.unique(made.lengths, return_inverse=True)
    m = np.array([100 - B + (B * s * seen.documents) // max(seen.all_terms, 1) for s in sizes.tolist()], np.int64)[which]
    value = (1_000_000_000 * made.tf) // (1000 * made.tf + 20 * m[made.doc])
    return value * np.repeat(weight, np.diff(made.first))


class _Best:
    """The best k (score, document) of an item so far: higher scores first, then ascending id, null last."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.score, self.id, self.unknown = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        at = np.flatnonzero(score >= self.floor)
        if not len(at):
            return
        score, ids, unknown = np.concatenate([self.score, score[at]]), np.concatenate([self.id, ids[at]]), np.concatenate([self.unknown, unknown[at]])
        best = np.lexsort((ids, unknown, -score))[: self.k]
        self.score, self.id, self.unknown = score[best], ids[best], unknown[best]
        if len(best) == self.k:
            self.floor = max(1, int(self.score[-1]))


def _scored(docs: DataFrame, block: Items, seen: Counts, k: int) -> DataFrame:
    """(place, doc_id, score): for each task over docs (doc_id, text), the best k of each item of the block."""
    weight = weights(seen)

    def run(batches):
        best = [_Best(k) for _ in block.ids]
        for part in portions(batches, 1, PORTION):
            made = matrix(part.column(1), block.terms)
            value = impacts(made, seen, weight)
            ids = pc.fill_null(part.column(0), 0).to_numpy(zero_copy_only=False)
            unknown = part.column(0).is_null().to_numpy(zero_copy_only=False)
            starts, lengths = made.first[:-1], np.diff(made.first)
            for item, found in enumerate(best):
                own = slice(block.first[item], block.first[item + 1])
                rows, times = block.term[own], block.times[own]
                cells = gather(starts[rows], lengths[rows])
                score = np.zeros(part.num_rows, np.int64)
                np.add.at(score, made.doc[cells], value[cells] * np.repeat(times, lengths[rows]))
                found.add(score, ids, unknown)
        for item, found in enumerate(best):
            if len(found.id):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.id), item, np.int64)), pa.array(found.id, mask=found.unknown), pa.array(found.score)], names=["place", "doc_id", "score"])

    return docs.mapInArrow(run, "place long, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, k: int = K, once: bool = False, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items, the k rows of docs that score highest above 0."""
    spark = items.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    schema = f"place long, item_id {items.schema[item_id].dataType.simpleString()}"
    found = []
    for block in item_blocks(items.select(F.col(item_id), F.col(item_text).cast("string")), once):
        best = _scored(slim, block, counts(slim.select("text"), block.terms), k)
        for parts in ([salt], []):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy("place", *parts).orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), schema)
        found.append(best.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"{schema.split(', ')[1]}, rank int, doc_id long, score long")
    return reduce(DataFrame.union, found)


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), K, once=True)


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), q AS (
  SELECT row_number() OVER () AS qid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark
), c AS (
  SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS n, CAST(coalesce(sum(len(ts)), 0) AS BIGINT) AS l FROM d
), qt AS (
  SELECT DISTINCT qid, unnest(ts) AS t FROM q
), p AS (
  SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY rid, t
), w AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * c.n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c
), i AS (
  SELECT p.rid, p.t, w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len(d.ts) * c.n) // c.l)))) AS v FROM p JOIN w USING (t) JOIN d USING (rid), c
), s AS (
  SELECT qt.qid, i.rid, sum(v) AS score FROM qt JOIN i USING (t) GROUP BY qt.qid, i.rid
), r AS (
  SELECT q.qid, q.item_id, d.doc_id, CAST(s.score AS BIGINT) AS score, row_number() OVER (PARTITION BY q.qid ORDER BY s.score DESC, d.doc_id NULLS LAST) AS rank
  FROM s JOIN q USING (qid) JOIN d USING (rid) WHERE s.score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""
