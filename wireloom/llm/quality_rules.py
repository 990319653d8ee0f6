"""Quality rules: a ledger with one failure bit per rule, read by versioned policies.

``ledger`` evaluates every rule once and stores measurements and failure bits.  ``verdict`` applies a policy,
which is a mask over the bits, and ``ablation`` tells from the bits alone what each rule of a policy costs.
Everything is a built-in expression on one row, so no text is shuffled.

Null texts count as empty.  Empty texts have measurements of 0 and fail ``few_words``.  Ties and repeated rows do
not matter, as rows are judged alone; other columns of the input are passed on by ``ledger`` unless their names
are among the ledger's, which replace them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8

#: name -> condition over the measurements; the position gives the bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "100 * n_capitals > 60 * word_chars",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
POLICIES = {"base": BASE, "v1": (1 << len(RULES)) - 1}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _covered(positions: Column, width: int) -> Column:
    """Words under windows of this width at these ascending positions."""
    n = F.size(positions)
    steps = F.zip_with(F.slice(positions, 2, n - 1), F.slice(positions, 1, n - 1), lambda b, a: F.least(b - a, F.lit(width)))
    return F.lit(width) + _total(steps)


def _repeats(windows: Column) -> Column:
    """Ascending positions of window hashes that occur twice or more."""

    def among(ordered):
        n = F.size(ordered)
        same = lambda x, k: F.get(ordered, k)["h"] == x["h"]
        twice = F.filter(ordered, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(F.when(k + 1 < n, same(x, k + 1)), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), among)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of so many words that occur twice or more, the first included.

    Windows are compared by a 64-bit hash within one text; only texts with an equal pair are sorted.
    """

    def count(w):
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        return F.when(F.size(w) < width + 1, F.lit(0)).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(_repeats(h), lambda p: _covered(p, width))))
        )

    return let(words, count)


def measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "words": let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeat"))),
        "lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
        "word_chars": without(BLANKS),
        "n_symbols": F.length(text) - without(SYMBOLS),
        "n_capitals": F.length(text) - without("".join(map(chr, range(65, 91)))),
    }


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measurements (long) and ``failures``, a bit for each rule that the text fails."""
    own = "wireloom_ledger"
    kept = [c for c in df.columns if c not in (*MEASURES, "failures", own)]
    measured = df.withColumn(own, F.struct(*[c.alias(k) for k, c in measures(F.col(text)).items()]))
    at = {"n_words": "words.n", "n_repeat_words": "words.repeat", "n_lines": "lines.n", "n_dup_lines": "lines.dup"}
    measured = measured.select(*kept, *[F.col(f"{own}.{at.get(m, m)}").cast("long").alias(m) for m in MEASURES])
    bits = [F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)) for name, condition in RULES.items()]
    return measured.withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def verdict(failures: Column, policy: str = "v1") -> Column:
    """Whether the text passes all rules of the policy."""
    return failures.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: texts that fail it, that fail it alone, and that pass if it is dropped.

    entries: a ledger.  Bits are counted first, so at most 2^rules rows are expanded.
    """
    mask = POLICIES[policy]
    counts = entries.select(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask])
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.lit(mask) - F.col("bit")) == 0
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(has & rest, F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("passed_without"),
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    entries = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict(F.col("failures"), "base")).alias("base_failed"), verdict(F.col("failures"), "v1").alias("kept"), "failures",
    )


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), pos AS (
  SELECT rid, ws, unnest(range(1, greatest(len(ws) - 7, 0) + 1)) AS i FROM w
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS s FROM pos
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY rid
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
      + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
      + (CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END)
      + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
      + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
      + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
      + (CASE WHEN 100 * n_capitals > 60 * word_chars THEN 64 ELSE 0 END) AS BIGINT) AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM b
"""
