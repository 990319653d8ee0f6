"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is dealt into blocks by a hash of its documents.  Its target is met by whole passes over its blocks, then
blocks in a permuted (hashed) order, then documents of one last block in a hashed order, the last of them in part.  The
block uses that this takes, numbered in the permuted order, are the source's quota.

A tree of multivariate-hypergeometric draws splits the quotas of all sources among the output shards, first for groups
of sources, which are at most ``GROUPS``, then within each group for its sources; so each shard gets its share of every
source up to what a random deal would give, and no table of all sources is in one task.  A shard then draws its next
numbers of each source's order, which are disjoint from those of the others.  What is taken of a document is what the
shards drew of its block: a use that no shard draws is not taken.  A shard shuffles its documents locally, by a hash.

Documents are joined with the table of block uses and never gathered by source.  Blocks without a word have no use.
There may be 10^9 block uses in all, which is the limit of the draws.

Null texts and texts without words have size 0 and take 0.  A null source is a source, the last one.  Repeated rows are
documents of their own; where all their columns are equal they take the same.  Other columns of the input are kept by
``mix`` unless they have the name of a result, which replaces them; ``written`` keeps all columns as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Tables, numbered
from .common import WORD, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
LIMIT = 2
SHARDS = 16
GROUPS = 1024
#: A block holds about BLOCK_DOCUMENTS documents; sources of over BLOCKS such blocks have larger ones, of up to LARGEST documents.
BLOCKS, BLOCK_DOCUMENTS, LARGEST = 1024, 32, 65_536
#: Bytes of text in one of a shard's files, about.
FILE_BYTES = 32 << 20
RESULTS = ("size", "source_size", "target", "taken", "shards", "copy", "shard", "place", "words")
#: The input's own columns travel as one, so that none of their names meets one used here.
ROW = "wireloom_row"


def sizes(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """by_source (source, source_size, ...) with ``target``: shares by weight, none above limit times its size.

    Each round caps the sources above their limit and shares the excess among the rest by weight, until none is above.
    A round is one aggregate over the sources; two numbers come to the driver.
    """
    columns = by_source.columns
    ranked = numbered(by_source.withColumn("wireloom_null", F.col("source").isNull()), ["wireloom_null", "source"], "wireloom_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("wireloom_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("wireloom_weight", weight).withColumn("wireloom_cap", limit * F.col("source_size").cast("double"))
    total = (by_source.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        above = F.col("wireloom_weight") * level > F.col("wireloom_cap")
        n, caps, free = ranked.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("wireloom_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("wireloom_weight"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - caps) / free
    return ranked.withColumn("target", F.least("wireloom_cap", F.col("wireloom_weight") * level)).select(*columns, "target")


def balanced(total: int, shards: int) -> np.ndarray:
    """The total in shards parts that differ by one at most."""
    return np.diff(np.arange(shards + 1, dtype=np.int64) * total // shards)


def split(quotas: np.ndarray, totals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Block uses of each source for each shard, given how many each shard takes in all.

    A tree halves the shards; at each node the left half's uses are drawn from the node's without replacement.
    """
    out = np.zeros((len(totals), len(quotas)), np.int64)
    todo = [(0, len(totals), quotas.astype(np.int64))]
    while todo:
        low, high, have = todo.pop()
        if high - low == 1:
            out[low] = have
            continue
        middle = (low + high) // 2
        left = rng.multivariate_hypergeometric(have, int(totals[low:middle].sum()), method="marginals")
        todo += [(low, middle, left), (middle, high, have - left)]
    return out


def plan(blocks: DataFrame, seed: int) -> DataFrame:
    """The blocks that hold words, with their source's passes over all of them and the words a last pass takes of each.

    blocks (source, block, block_size, source_size, target) get passes, remainder, n and p (the source's blocks and
    those of its last pass), rank (their place in the source's permuted order) and source_key.
    """
    some = blocks.filter("block_size > 0").withColumn("source_key", F.xxhash64(F.lit(seed), "source", F.col("source").isNull()))
    some = some.withColumn("order", F.xxhash64(F.lit(seed), "source_key", "block"))
    place = Window.partitionBy("source_key").orderBy("order", "block")
    of_source = Window.partitionBy("source_key")
    aim = F.floor(F.col("target") + 0.5)
    some = some.withColumn("passes", F.floor(aim / F.col("source_size")).cast("int"))
    before = F.coalesce(F.sum("block_size").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = aim - F.col("passes") * F.col("source_size") - before
    some = some.withColumn("remainder", F.greatest(F.lit(0), F.least("block_size", rest))).withColumn("rank", F.row_number().over(place) - 1)
    return some.withColumn("n", F.count("*").over(of_source)).withColumn("p", F.count_if(F.col("remainder") > 0).over(of_source)).drop("order")


def drawn(planned: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_key, number, shard): the numbers of each source's uses that each shard draws."""
    quotas = planned.groupBy("source_key").agg(F.max(F.col("passes") * F.col("n") + F.col("p")).alias("quota"))
    quotas = quotas.filter("quota > 0").withColumn("group", F.pmod("source_key", F.lit(GROUPS)).cast("int"))

    def groups(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group")
        out = split(pdf["quota"].to_numpy(), balanced(int(pdf["quota"].sum()), shards), np.random.default_rng(seed))
        return pd.DataFrame({"at": pdf["group"], "totals": list(out.T)})

    def sources(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source_key").reset_index(drop=True)
        out = split(pdf["quota"].to_numpy(), np.asarray(pdf["totals"].iloc[0]), np.random.default_rng([seed, int(pdf["group"].iloc[0])]))
        stop = np.cumsum(out, 0)
        shard, source = np.nonzero(out)
        return pd.DataFrame({"source_key": pdf["source_key"].to_numpy()[source], "shard": shard.astype(np.int32), "start": (stop - out)[shard, source], "stop": stop[shard, source]})

    of_group = quotas.groupBy("group").agg(F.sum("quota").alias("quota")).groupBy(F.lit(0).alias("all")).applyInPandas(groups, "at int, totals array<long>")
    each = quotas.join(of_group, F.col("at") == F.col("group")).select("source_key", "quota", "group", "totals")
    runs = each.groupBy("group").applyInPandas(sources, "source_key long, shard int, start long, stop long")
    return runs.select("source_key", "shard", F.explode(F.sequence("start", F.col("stop") - 1)).alias("number"))


def uses_of(planned: DataFrame, shards: int, seed: int) -> DataFrame:
    """planned with ``uses``, the (copy, shard) of each use that a shard drew; copy ``passes`` is the last pass.

    The uses of the last pass come first in the source's order, those of whole passes after them.
    """
    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.col("passes") - 1), lambda c: F.struct(c.alias("copy"), (F.col("p") + c * F.col("n") + F.col("rank")).alias("number"))))
    last = F.when(F.col("remainder") > 0, F.array(F.struct(F.col("passes").alias("copy"), F.col("rank").cast("long").alias("number"))))
    none = F.array().cast("array<struct<copy:int,number:bigint>>")
    asked = planned.select("source_key", "block", F.inline(F.concat(F.coalesce(whole, none), F.coalesce(last, none))))
    got = asked.join(drawn(planned, shards, seed), ["source_key", "number"])
    got = got.groupBy(F.col("source_key").alias("k"), F.col("block").alias("b")).agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("uses"))
    return planned.join(got, (F.col("k") == F.col("source_key")) & (F.col("b") == F.col("block"))).select("source", "block", "block_size", "passes", "remainder", "uses")


def _taken(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, shards: int = SHARDS, seed: int = 7, blocks: int = BLOCKS, block_documents: int = BLOCK_DOCUMENTS, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: list[str] | None = None) -> tuple[DataFrame, float]:
    """Each row of docs with what the mix takes of it, and the words of all targets; keep: the columns of docs that go along, else all."""
    tables = Tables(docs.sparkSession)
    mine = "wireloom_source"
    hashed = F.xxhash64(F.lit(seed), doc_id, source, text)
    sized = docs.select(F.struct(*(keep or docs.columns)).alias(ROW), sizes(text).alias("size"), F.col(source).cast("string").alias(mine), hashed.alias("wireloom_order"))
    slim = tables.cut(sized.select(F.col(mine).alias("source"), "size", F.col("wireloom_order").alias("u")), "sizes")
    by_source = tables.cut(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")), "sources")
    n_blocks = F.least(F.ceil(F.col("documents") / block_documents), F.greatest(F.lit(blocks), F.ceil(F.col("documents") / LARGEST))).cast("int")
    aims = tables.cut(targets(by_source, weights, share, limit).withColumn("n_blocks", n_blocks), "targets")
    total = aims.agg(F.sum("target")).first()[0] or 0.0
    aim = aims.select(F.col("source").alias("s"), "source_size", "target", "n_blocks")
    block = lambda u: F.pmod(u, F.col("n_blocks")).cast("int")
    of_block = slim.join(aim, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", block(F.col("u"))).groupBy("source", "block", "source_size", "target").agg(F.sum("size").alias("block_size"))
    used = tables.cut(uses_of(tables.cut(plan(of_block, seed), "plan"), shards, seed), "uses")
    # in the one block of a source that the last pass cuts, documents are taken in their order up to the remainder
    cuts = used.filter("remainder > 0 AND remainder < block_size").select(F.col("source").alias("s"), F.col("block").alias("b"), "remainder")
    inside = slim.join(aim, F.col("source").eqNullSafe(F.col("s"))).select("source", block(F.col("u")).alias("block"), "size", "u")
    inside = inside.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    # rows with equal columns have one order and take the same part
    inside = inside.groupBy("source", "block", "u", "remainder").agg(F.min("size").alias("size"), F.sum("size").alias("all"), F.count("*").alias("n"))
    running = Window.partitionBy("source", "block").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), F.col("remainder") - F.coalesce(F.sum("all").over(running), F.lit(0)))
    part = inside.withColumn("part", F.least("size", F.floor(left / F.col("n")))).select(F.col("u").alias("pu"), F.col("source").alias("ps"), "part")
    of_uses = used.select(F.col("source").alias("s2"), F.col("block").alias("b2"), "passes", "remainder", "block_size", "uses")
    out = sized.join(aim, F.col(mine).eqNullSafe(F.col("s"))).drop("s").withColumn("b", block(F.col("wireloom_order"))).drop("n_blocks")
    out = out.join(of_uses, F.col(mine).eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")), "left").drop("s2", "b2", "b")
    out = out.join(part, (F.col("wireloom_order") == F.col("pu")) & F.col(mine).eqNullSafe(F.col("ps")), "left").drop("pu", "ps")
    last = F.when(F.col("remainder") == F.col("block_size"), F.col("size")).otherwise(F.coalesce("part", F.lit(0)))
    uses = F.coalesce("uses", F.array().cast("array<struct<copy:int,shard:int>>"))
    uses = F.transform(uses, lambda u: F.struct(u["copy"].alias("copy"), u["shard"].alias("shard"), F.when(u["copy"] < F.col("passes"), F.col("size")).otherwise(F.col("wireloom_last")).alias("words")))
    out = out.withColumn("wireloom_last", last).withColumn("uses", uses).withColumn("taken", F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["words"]))
    return out.select(ROW, "size", "source_size", "target", "taken", "uses", "wireloom_order"), total


def _own(columns: list[str]) -> list[Column]:
    return [F.col(ROW)[c].alias(c) for c in columns if c not in RESULTS]


def quotas(docs: DataFrame, text: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """docs with size, source_size, target, taken (words that the shards drew), and the shards of its uses.

    keep: the columns of docs to return, else all; texts that are not kept are not shuffled.
    """
    taken, _ = _taken(docs, text=text, keep=keep, **options)
    shards = F.transform(F.filter("uses", lambda u: u["words"] > 0), lambda u: u["shard"]).alias("shards")
    return taken.select(*_own(keep or docs.columns), "size", "source_size", "target", "taken", shards)


def _drawn_texts(taken: DataFrame, text: str) -> DataFrame:
    """A row for each use, with its place, a hash that shuffles a shard; a text without words is used once."""
    uses = taken.select(ROW, "size", "source_size", "target", "taken", "wireloom_order", F.inline("uses"))
    uses = uses.filter((F.col("words") > 0) | ((F.col("size") == 0) & (F.col("copy") == 0)))
    whole = F.col(ROW)[text]
    head = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    return uses.withColumn("wireloom_text", F.when(F.col("words") < F.col("size"), head).otherwise(whole)).withColumn("place", F.xxhash64("wireloom_order", "copy"))


def mix(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix: docs' columns once for each use, with shard, place in the shard and words; a part's text is its words, joined by one blank.

    Sort by (shard, place) to write shards: places are hashes, which shuffle a shard locally.
    """
    taken, _ = _taken(docs, text=text, **options)
    own = [F.col("wireloom_text").alias(text) if c == text else x for c, x in zip([c for c in docs.columns if c not in RESULTS], _own(docs.columns), strict=True)]
    return _drawn_texts(taken, text).select(*own, "size", "source_size", "target", "taken", "copy", "shard", "words", "place")


def written(docs: DataFrame, text: str = "text", shards: int = SHARDS, file_bytes: int = FILE_BYTES, **options) -> DataFrame:
    """The mix with docs' own columns only, dealt and sorted by (shard, place): each file belongs to one shard."""
    taken, words = _taken(docs, text=text, shards=shards, **options)
    files = max(1, round(7 * words / shards / file_bytes))  # a word and its blank have about seven bytes
    uses = _drawn_texts(taken, text)
    own = [F.col("wireloom_text").alias(text) if c == text else F.col(ROW)[c].alias(c) for c in docs.columns]
    uses = uses.select(F.struct(*own).alias(ROW), "shard", "place")
    file = (F.col("shard") * files + F.pmod("place", F.lit(files))).cast("int")
    return uses.withColumn("file", file).repartitionById(shards * files, "file").sortWithinPartitions("file", "place").select(f"{ROW}.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quotas(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "shards")
