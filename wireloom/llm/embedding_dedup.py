"""Embedding near-dedup: spherical k-means cells, blocked cosines, one representative for each group of linked vectors.

Equal vectors are collapsed first.  A vector's home is the cell of its nearest centroid; it also visits each lower cell
that may hold a vector linked with it: for unit vectors u of that cell and v with cosine t or more, |u - v| is at most
d = sqrt(2 - 2t), so v.(c - c') <= d |c - c'| for the cell's centroid c' and every other centroid c.  All others
are ruled out, so no link is lost.  A cell is compared in tiles of at most about ``TILE_BYTES``, and a pair of tiles
reports for each vector its links and the least vector that it is connected with, never the pairs.

The number of cells is the cheapest by what vectors of the sample visit: where vectors lie in clusters more cells rule
more out, while among vectors without any structure nearly all cells may hold a link, so few cells are made and the
comparisons are those of all pairs.

Centroids are fitted on ``SAMPLE`` vectors at most, chosen by a hash; every vector is compared.  Cosines are in double
precision.  Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept;
so do rows with a null id, whose component is null.  Shorter vectors count as filled up with zeros.  Repeated rows are
vectors of their own, which are linked; rows with one id share their component.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..shared import Tables
from .common import table

COSINE = 0.95
SAMPLE = 16_384
#: The fewest cells, and vectors of the sample for each cell at least.
LEAST_CELLS, FOR_CELL = 8, 16
#: A tile's vectors take so many bytes at most, and are so many at most.
TILE_BYTES, TILE = 4 << 20, 8192
ROUNDS = 10
#: Seconds, about, that a component of a pair takes to multiply, a pair to compare, a byte of a vector to move and a vector to place by a pair of cells.
MULTIPLIED, COMPARED, MOVED, PLACED = 1e-10, 3e-9, 3e-8, 2e-9


def unit(lists: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """The vectors at length one, in double precision."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lists), size))
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    out /= np.abs(out).max(1, keepdims=True)  # so that squares of very small or large components don't vanish or overflow
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def nearest(vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([(vectors[low : low + 2048] @ at.T).argmax(1) for low in range(0, len(vectors), 2048)])


def centroids(sample: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Spherical k-means: each centroid is the direction of the sum of its cell."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        cell = nearest(sample, at)
        total = np.zeros_like(at)
        np.add.at(total, cell, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        at = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), at)
    return at


def cheapest(sample: np.ndarray, n: int, cosine: float, tile: int) -> np.ndarray:
    """Centroids of that number of cells, doubled from the least, whose comparisons and moves cost least for n vectors."""
    best, low, k = None, np.inf, LEAST_CELLS
    while best is None or k <= len(sample) // FOR_CELL:
        at = centroids(sample, k)
        size = np.bincount(nearest(sample, at), minlength=len(at)) * (n / len(sample))
        home, may = visits(sample[:: max(1, len(sample) // 512)], at, cosine)
        met = may @ size + size[home] / 2
        moved = may @ np.ceil(size / tile) + np.ceil(size / tile)[home]
        cost = met.mean() * (sample.shape[1] * MULTIPLIED + COMPARED) + moved.mean() * sample.shape[1] * 8 * MOVED + len(at) ** 2 * PLACED
        if cost > 1.5 * low:
            break
        if cost < low:
            best, low = at, cost
        k *= 2
    return best


def visits(vectors: np.ndarray, at: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and for each cell whether it is lower than home and may hold a linked vector."""
    near = vectors @ at.T
    home = near.argmax(1)
    reach = np.sqrt(2 - 2 * cosine) * np.linalg.norm(at[:, None] - at[None], axis=2) + 1e-9
    may = np.arange(len(at))[None] < home[:, None]
    for c in range(len(at)):  # the centroid c must not be nearer by more than a link can bridge
        may &= near[:, c, None] - near <= reach[c][None]
    return home, may


def connected(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each place, the least id it is connected with by the links (one, two)."""
    label = ids.copy()
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        np.minimum.at(new, one, low)
        np.minimum.at(new, two, low)
        if (new == label).all():
            return label
        label = new


def compared(size: int, cosine: float):
    def run(key, rows):
        """One pair of tiles: links and least connected vector of those that have a link."""
        rows = rows.combine_chunks()
        vectors = unit(rows["embedding"], size)
        ids, code, times = rows["rep"].to_numpy(), rows["code"].to_numpy(), rows["times"].to_numpy()
        left, right = rows["left"].to_numpy(zero_copy_only=False), rows["right"].to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        one, two = [], []
        for low in range(0, len(a), 512):
            part = a[low : low + 512]
            i, j = np.nonzero(vectors[part] @ vectors[b].T >= cosine)
            one.append(part[i])
            two.append(b[j])
        none = np.zeros(0, np.int64)
        one, two = np.concatenate([none, *one]), np.concatenate([none, *two])
        once = ~(left[two] & right[one]) | (one < two)  # within one tile a pair is met twice, and a vector meets itself
        one, two = one[once], two[once]
        links = np.bincount(one, times[two], len(ids)) + np.bincount(two, times[one], len(ids))
        some = np.flatnonzero(links)
        return pa.table([pa.array(ids[some]), pa.array(code[some]), pa.array(links[some].astype(np.int64)), pa.array(connected(one, two, ids)[some])], names=["rep", "code", "links", "least"])

    return run


def links(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", cells: int | None = None, tile: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    cells: the number of cells, else the cheapest; tile: vectors of a tile, else those of TILE_BYTES.
    """
    tables = Tables(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    each = rows.filter("good").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")).withColumn("code", F.xxhash64("embedding"))
    each = tables.cut(each, "vectors")
    n, size = each.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    chosen = each.orderBy("code", "rep").limit(SAMPLE).select("embedding").toArrow()
    tile = tile or min(TILE, max(256, TILE_BYTES // (8 * size)))
    sample = unit(chosen["embedding"], size)
    at = centroids(sample, cells) if cells else cheapest(sample, n, cosine, tile)

    def place(batches):
        for batch in (b.slice(low, 1024) for b in batches for low in range(0, b.num_rows, 1024)):
            home, may = visits(unit(batch.column(0), size), at, cosine)
            row, cell = np.nonzero(may)
            every = np.concatenate([np.arange(len(home)), row])
            part = batch.take(pa.array(every))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate([home, cell]), pa.int32()), pa.array(np.arange(len(every)) < len(home))], names=["embedding", "rep", "times", "code", "cell", "home"])

    placed = tables.cut(each.select("embedding", "rep", "times", "code").mapInArrow(place, "embedding array<double>, rep long, times long, code long, cell int, home boolean"), "cells")
    held = placed.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.count_if("home") / tile).cast("int").alias("h"), F.ceil(F.count_if(~F.col("home")) / tile).cast("int").alias("v"))
    # a row for each cell, of which there are at most SAMPLE / FOR_CELL; a cell's pairs of tiles are then dealt one by one
    tiles = placed.join(F.broadcast(held), F.col("c") == F.col("cell"))
    # tiles 0 to h - 1 are of residents, h to h + v - 1 of visitors; residents are compared with all of them
    place_in = F.when(F.col("home"), F.pmod("code", "h")).otherwise(F.col("h") + F.pmod("code", "v")).cast("int")
    tiles = tiles.withColumn("tile", place_in)
    as_left = F.transform(F.sequence(F.col("tile"), F.col("h") + F.col("v") - 1), lambda j: F.struct(F.col("tile").alias("i"), j.alias("j"), F.lit(True).alias("left"), (j == F.col("tile")).alias("right")))
    upto = F.least(F.col("tile"), F.col("h")) - 1
    as_right = F.when(upto >= 0, F.transform(F.sequence(F.lit(0), upto), lambda i: F.struct(i.alias("i"), F.col("tile").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))))
    none = F.slice(as_left, 1, 0)
    uses = F.concat(F.when(F.col("home"), as_left).otherwise(none), F.coalesce(as_right, none))
    dealt = tiles.select("cell", "embedding", "rep", "times", "code", F.inline(uses))
    found = dealt.groupBy("cell", "i", "j").applyInArrow(compared(size, cosine), "rep long, code long, links long, least long")
    found = tables.cut(found, "links")
    tables.drop("cells")
    total = found.groupBy(F.col("rep").alias("r"), F.col("code").alias("k")).agg(F.sum("links").alias("links"))
    # rows of one id with different vectors share a component
    ids = rows.filter("good").select("vec_id", "embedding").join(each.select(F.col("embedding").alias("e"), "rep"), F.col("e") == F.col("embedding"))
    several = ids.groupBy(F.col("vec_id").alias("s")).agg(F.count_distinct("embedding").alias("n")).filter("n > 1").select("s")
    same = ids.join(several, F.col("s") == F.col("vec_id"), "left_semi").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    named = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")).union(same))
    known = each.join(total, (F.col("r") == F.col("rep")) & (F.col("k") == F.col("code")), "left").join(named, F.col("vertex") == F.col("rep"), "left")
    known = known.select(F.col("embedding").alias("e"), F.lit(True).alias("g"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(known, (F.col("e") == F.col("embedding")) & (F.col("g") == F.col("good")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.when(F.col("good"), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))
