"""Target-distribution importance resampling: documents drawn by how much likelier a target makes their word runs.

Features are all runs of 1 to ``width`` consecutive words, joined by one blank, hashed to buckets by the CRC-32 of their
bytes.  One scan of a text keeps a ring of running zlib states, one for each of the last ``width`` starts; a word
extends each by a blank and itself, begins one of its own, and each state gives a bucket.  A bucket's gain is
floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for its s of S features in the documents and t of T in
the target.  A document's weight is the floored mean of its features' gains, its score that weight plus Gumbel noise
from a hash of seed and id; of the documents with ``least`` words or more, so many percent are drawn by score.

The words are runs of digits, letters and anything beyond ASCII, with A-Z in lower case.  Null and empty texts have no
features, and weight 0.  Equal scores are drawn by ascending doc_id (null first), then fewer features; rows with one id
have one noise, and each counts as a document.  A null id is hashed as no text.  Only the columns named are read.  Empty
tables give an empty result; an empty target has T = 0.  A text is read in pieces, so only its bytes are held whole.
Bucket counts (two numbers a bucket) go through the driver, as their number is a parameter; documents are ranked by
ranges of the score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import numbered
from .common import cut, table
from .words import TERM, portions

WIDTH, BUCKETS, SEED, LEAST, PERCENT = 1, 10_000, 2024, 20, 10
PIECE = 1 << 20
_MAP = TERM.tobytes()


def hashes(text: bytes, width: int, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """For each piece of a text, its number of words and the CRC-32 of each run of at most so many words that ends there."""
    at, ring = 0, []
    while at < len(text):
        # a piece ends before a byte that divides words
        to = at + piece
        while to < len(text) and _MAP[text[to]] != 32:
            to += 1
        words = text[at:to].translate(_MAP).split()
        at = to
        if width == 1:  # a ring of one state
            yield len(words), np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
            continue
        out = []
        for word in words:
            step = b" " + word
            ring = [zlib.crc32(step, state) for state in ring[1 - width :]]
            ring.append(zlib.crc32(word))
            out += ring
        yield len(words), np.array(out, np.uint32)


def _texts(batches, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for part in portions(batches, column):
        yield part, part.column(column).cast(pa.large_binary()).to_pylist()


def bucket_counts(df: DataFrame, text: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for _, texts in _texts(batches, 0):
            for value in texts:
                for _, found in hashes(value or b"", width):
                    total += np.bincount(found % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    total = np.zeros(buckets, np.int64)
    counted = df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""

    def run(batches):
        for part, texts in _texts(batches, 1):
            words, features, weight = (np.zeros(part.num_rows, np.int64) for _ in range(3))
            for k, value in enumerate(texts):
                total = 0
                for n, found in hashes(value or b"", width):
                    words[k] += n
                    features[k] += len(found)
                    total += int(gain[found % len(gain)].sum())
                weight[k] = total // max(int(features[k]), 1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, width: int = WIDTH, buckets: int = BUCKETS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of docs; rank is null where it is not drawn."""
    gain = gains(bucket_counts(docs, text, width, buckets), bucket_counts(target, target_text, width, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = cut(weighed(docs, gain, doc_id, text, width).withColumn("score", F.col("weight") + noise), "scored")
    enough = scored.filter(F.col("n_words") >= least)
    drawn = enough.count() * percent // 100
    placed = numbered(enough.withColumn("wireloom_down", -F.col("score")), ["wireloom_down", "doc_id", "n_features"], "wireloom_place")
    ranked = placed.withColumn("rank", F.when(F.col("wireloom_place") < drawn, F.col("wireloom_place") + 1)).drop("wireloom_down", "wireloom_place")
    return ranked.unionByName(scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH k AS (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents
), f AS (
  SELECT rid, unnest(ws) AS w FROM d
), g AS (
  SELECT unnest({_WORDS}) AS w FROM benchmark
), v AS (
  SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM g)
), e AS (
  SELECT w, xor(4294967295, list_reduce(list_transform(range(len(x) // 2), lambda j: CAST('0x' || substr(x, CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, y: xor(c >> 8, k.t[xor(c & 255, y) + 1]), CAST(4294967295 AS BIGINT))) % {BUCKETS} AS b FROM v, k
), s AS (
  SELECT b, count(*) AS n FROM f JOIN e USING (w) GROUP BY b
), t AS (
  SELECT b, count(*) AS n FROM g JOIN e USING (w) GROUP BY b
), a AS (
  SELECT (SELECT count(*) FROM f) AS s, (SELECT count(*) FROM g) AS t
), n AS (
  SELECT b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (a.s + {BUCKETS}) AS DOUBLE) / CAST((s.n + 1) * (a.t + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), a
), m AS (
  SELECT rid, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN e USING (w) JOIN n USING (b) GROUP BY rid
), c AS (
  SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN m USING (rid)
), r AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= {LEAST}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM c LEFT JOIN r USING (rid)
"""
