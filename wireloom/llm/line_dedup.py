"""Line dedup: lines that many distinct sites share are boilerplate and stay in one document only.

The spread of a line is the number of distinct sites among the documents that hold it.  Sites are first counted once
for each line hash and site; HyperLogLog sketches of these merge by aggregation, and lines whose estimate lies near
the threshold get an exact distinct count.  A boilerplate line stays in the document with the smallest id that holds
it and goes from all others.  Only hashes are grouped; texts are joined with their few hashes and filtered in place.

Lines are cut at newlines and compared without the blanks around them; lines without a word are no candidates and
always stay.  Null texts have no lines and stay null.  A null site is a site of its own.  Rows with one id count as one
document; rows without an id lose every boilerplate line that another document keeps.  Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, table

MIN_SITES = 10
LG_K = 12
#: Five standard errors of a sketch of 2^12 registers, and one site.
BAND = 5 * 1.04 / 2 ** (LG_K / 2)
BLANKS = " \t\r\x0b\x0c"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """(key, first_doc) of the boilerplate among lines (key, site, doc_id)."""
    by_site = lines.groupBy("key", "site").agg(F.min("doc_id").alias("first_doc"))
    by_site = cut(by_site, "sites")
    sketches = by_site.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("first_doc").alias("first_doc"))
    estimated = sketches.select("key", "first_doc", F.hll_sketch_estimate("sketch").alias("sites"))
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    estimated = cut(estimated.filter(F.col("sites") >= low), "spread")
    near = estimated.filter(F.col("sites") <= high).select(F.col("key").alias("near"))
    exact = by_site.join(near, F.col("near") == F.col("key"), "left_semi").groupBy("key").agg(F.count("*").alias("sites"), F.min("first_doc").alias("first_doc"))
    sure = estimated.filter(F.col("sites") > high).select("key", "first_doc")
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("key", "first_doc"))


def dedup(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """docs with the boilerplate gone from the texts, and ``wireloom_removed``, the lines that went."""
    lines = F.filter(_lines(text), lambda x: x.rlike(WORD))
    keys = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(site).cast("string"), F.col(site).isNull()).alias("site"), F.explode(F.array_distinct(F.transform(lines, _hash))).alias("key")
    )
    boilerplate = spread(keys, min_sites).select(F.col("key").alias("bad"), "first_doc")
    held = keys.join(boilerplate, F.col("bad") == F.col("key")).filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    own = held.groupBy(F.col("doc_id").alias("wireloom_id")).agg(F.collect_set("key").alias("wireloom_bad"))
    joined = docs.drop("wireloom_removed").join(own, F.col(doc_id).eqNullSafe(F.col("wireloom_id")), "left").drop("wireloom_id")
    kept = F.filter(_lines(text), lambda x: ~(x.rlike(WORD) & F.array_contains("wireloom_bad", _hash(x))))
    bad = F.col("wireloom_bad").isNotNull() & F.col(text).isNotNull()
    out = joined.withColumn("wireloom_kept", F.when(bad, F.array_join(kept, "\n")))
    removed = F.when(bad, F.size(_lines(text)) - F.size(kept)).otherwise(F.lit(0))
    out = out.withColumn("wireloom_removed", removed.cast("long")).withColumn(text, F.coalesce("wireloom_kept", F.col(text)))
    return out.select(*[c for c in docs.columns if c != "wireloom_removed"], "wireloom_removed")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return kept.select("doc_id", F.col("wireloom_removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents
), l AS (
  SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
), k AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS key, regexp_matches(line, '[^\x20\x09-\x0D]') AS cand FROM l
), b AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE cand GROUP BY key
  HAVING count(DISTINCT source) + CAST(count(*) > count(source) AS INTEGER) >= 10
), m AS (
  SELECT k.rid, k.pos, k.line, cand AND b.key IS NOT NULL AND k.doc_id IS DISTINCT FROM b.first_doc AS bad FROM k LEFT JOIN b ON k.key = b.key
), t AS (
  SELECT rid, count(*) FILTER (bad) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS kept FROM m GROUP BY rid
)
SELECT d.doc_id, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, CAST(length(t.kept) AS BIGINT) AS n_chars, sha256(t.kept) AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""
