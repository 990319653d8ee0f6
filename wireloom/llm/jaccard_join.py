"""N-gram Jaccard join by universe partition: exact links between documents whose shingle sets are alike.

Two sets with Jaccard similarity of at least t differ in at most H elements, where H follows from their sizes.  For
each band of sizes the universe of shingle hashes is cut into ``m`` segments, so a pair within the band meets in one:

    exact      m = H + 1 + s segments: at least 1 + s are equal.  A document drops the s segments with the fewest rare
               shingles (ties: by key), which are the most frequent keys; the pair's rarest equal segment stays on both sides.
    deletions  m = (H + 1) / 2 segments: in one of them the sets differ by one element at most, so one side's segment
               equals the other's or one of its one-deletion neighbours.

The allocation is chosen for each band by its cost, which is the keys plus the expected pairs of unrelated documents.
Equal sets are collapsed before keys are made.  Within a batch of documents a key's members are tied to one leader,
and only leaders and single members are sent to the key's bucket, where they are tied to a leader of all; so a hot key
sends one entry from each batch.  Members are compared with their leaders, then linked ones are merged into components;
in groups that still hold several, members of different components are compared in rounds, the most alike first, so
copies never give all pairs.  Of such a group the largest component's members meet the others only, in tiles of a
bounded size.  Parity sketches, whose bits differ at most as often as the sets, rule pairs out before texts move; every
link is verified exactly, on the texts' shingles, in parts of a bounded number of bytes.

Sets are of 64-bit hashes of word runs.  Null texts and texts without words have no shingles and link with nothing.
Rows with a null id link with nothing and have a null component.  Rows with one id are one document that has the links
of each of them.  Other columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..shared import Tables, small_batches
from .common import table
from .words import gather, hashes, mixed, offsets, portions, release, runs, words

WIDTH = 4
PERCENT = 85
RATIO = 1.3
KEY_BYTES = 6
FREQUENT = 20_000
NEAREST = 2
#: Bytes of a bucket's keys and ids, of the texts that one leader meets at once, and of the sketches of a tile or task.
BUCKET_BYTES, PART_BYTES, TILE_BYTES = 2 << 20, 1 << 20, 4 << 20
#: Bytes of keys that a task deals at once; numpy takes about 25 times as much for it.
DEALT_BYTES = 4 << 20
TILE, TASK_ROWS, LOCAL_ROWS = 2048, 20_000, 100_000


class Band(NamedTuple):
    low: int  # smallest size of the larger set
    high: int  # largest size
    differ: int  # elements in which a pair may differ
    segments: int
    drop: int
    deletions: bool


def bands(percent: int, largest: int) -> list[Band]:
    """Bands over the sizes of the larger set of a pair."""
    out, low = [], 1
    while low <= largest:
        high = max(low, math.floor(low * RATIO) - 1)
        differ = 2 * high * (100 - percent) // (100 + percent)
        drop = max(1, round(differ / 8))
        out.append(Band(low, high, differ, differ + 1 + drop, drop, False))
        low = high + 1
    return out


class Sizes(NamedTuple):
    """What one task may hold; none of these changes a result."""

    bucket: int = BUCKET_BYTES
    part: int = PART_BYTES
    tile: int = TILE
    tile_bytes: int = TILE_BYTES
    task: int = TASK_ROWS


def number_of_keys(plan: list[Band], counts: dict[int, int]) -> int:
    """About how many keys the documents have, which are at home in one band and may have partners in the next."""
    each = [(b.segments - b.drop + b.deletions * b.high) * (b.differ > 0) for b in [*plan, plan[-1]]]
    return sum(n * (each[k] + each[k + 1]) for k, n in counts.items())


def allocate(plain: list[Band], counts: dict[int, int]) -> list[Band]:
    """The cheaper allocation for each band, given the number of documents whose keys it holds."""
    out = []
    for k, band in enumerate(plain):
        n, size = counts.get(k, 0), (band.low + band.high) / 2
        empty = band.segments * math.exp(-size / band.segments)
        pairs = (n * empty / band.segments) ** 2 * band.segments / 2 if empty > band.drop / 2 else 0
        half = (band.differ + 2) // 2
        exact, deletions = n * (band.differ + 1) + pairs, n * (half + size) + (n * math.exp(-size / half)) ** 2 * half / 2
        out.append(band._replace(segments=half, drop=0, deletions=True) if deletions < exact else band)
    return out


class Sets(NamedTuple):
    values: np.ndarray  # the sets' hashes, ascending in each
    first: np.ndarray  # where each set begins, and the end

    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.sizes())


def shingles(texts, width: int) -> Sets:
    """The set of each text: hashes of its runs of words, or of all its words if they are fewer."""
    split = words(texts, lower=True)
    codes, distinct = split.codes()
    word = hashes(distinct)[codes]
    number = np.diff(split.first)
    text = np.repeat(np.arange(len(number)), number)
    found, owner = runs(word, width), text[: max(0, len(word) - width + 1)]
    whole = owner == text[width - 1 :] if len(owner) else np.zeros(0, bool)
    found, owner = [found[whole]], [owner[whole]]
    for n in range(1, width):
        few = np.flatnonzero(number == n)
        if len(few):
            parts = word[split.first[few][:, None] + np.arange(n)]
            total = np.full(len(few), n, np.uint64)
            for j in range(n):
                total = mixed(total ^ parts[:, j]) + parts[:, j]
            found.append(mixed(total))
            owner.append(few)
    values, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return Sets(values[new], offsets(np.cumsum(np.bincount(owner[new], minlength=len(number)))))


def totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of 64-bit integers, which wrap around."""
    with np.errstate(over="ignore"):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return running[first[1:]] - running[first[:-1]]


def digests(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set that do not depend on the order of its elements."""
    a = totals(mixed(sets.values ^ np.uint64(0x2545F4914F6CDD1D)), sets.first)
    return mixed(a), mixed(totals(mixed(sets.values + np.uint64(0xD6E8FEB86659FD93)), sets.first) ^ mixed(a + np.uint64(1)))


def sketches(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches: bytes of all, and where each begins and the last ends.

    Bit i tells whether an odd number of elements hash to i.  An element that only one of two sets has flips one bit,
    so two sketches differ in at most as many bits as the sets differ in elements.  A sketch has at least two bits for
    each element; folding its halves together gives the sketch of half its bits.
    """
    size = sets.sizes()
    bits = np.where(size > 0, np.maximum(256, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64)), 0)
    base = offsets(np.cumsum(bits))
    owner = sets.owners()
    bit = (mixed(sets.values + np.uint64(0xA0761D6478BD642F)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(base[owner] + bit, minlength=int(base[-1])) & 1
    return np.packbits(odd.astype(np.uint8)), base // 8


def folded(sketch: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(sketch, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def differences(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one.view(np.uint64) ^ two.view(np.uint64)).sum(-1, dtype=np.int64)


def may_link(n1: np.ndarray, n2: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in so many elements, or more, can be linked."""
    return differ * (100 + percent) <= (n1 + n2) * (100 - percent)


def band_range(sizes: np.ndarray, plan: list[Band], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The bands that hold a set as the larger one, and as the smaller one up to its largest partner."""
    highs = np.array([b.high for b in plan])
    return np.searchsorted(highs, sizes), np.minimum(np.searchsorted(highs, sizes * 100 // percent), len(plan) - 1)


def keys(sets: Sets, plan: list[Band], percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of all sets.  frequent: sorted hashes of shingles that are not rare."""
    low, high = band_range(sets.sizes(), plan, percent)
    m, drop, deleting = (np.array([getattr(b, k) for b in plan]) for k in ("segments", "drop", "deletions"))
    mix = mixed(sets.values)
    rare = np.ones(len(mix), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, sets.values), len(frequent) - 1)
        rare = frequent[at] != sets.values
    owners, found = [], []
    for step in range(int((high - low).max()) + 1 if len(low) else 0):
        some = np.flatnonzero((low + step <= high) & (sets.sizes() > 0))
        some = some[[plan[b].differ > 0 for b in (low[some] + step)]] if len(some) else some  # equal sets are collapsed
        if not len(some):
            continue
        band = low[some] + step
        size = sets.sizes()[some]
        token = gather(sets.first[some], size)
        local = np.repeat(np.arange(len(some)), size)
        base = np.cumsum(m[band]) - m[band]
        segment = ((sets.values[token] >> np.uint64(32)) * m[band][local].astype(np.uint64)) >> np.uint64(32)
        flat = base[local] + segment.astype(np.int64)
        n = int(m[band].sum())
        count = np.bincount(flat, minlength=n)
        total = totals(mix[token], offsets(np.cumsum(count)))
        owner = np.repeat(np.arange(len(some)), m[band])
        tag = mixed((band[owner].astype(np.uint64) << np.uint64(32)) | (np.arange(n) - base[owner]).astype(np.uint64))
        key = mixed(total + tag)
        keep = deleting[band][owner]
        exact = np.flatnonzero(~keep)
        if len(exact):
            weight = np.bincount(flat, rare[token], n).astype(np.int64)[exact]
            order = np.lexsort((key[exact], weight, owner[exact]))
            who = owner[exact][order]
            start = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            rank = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
            keep[exact[order]] = rank >= drop[band][who]
        owners.append(some[owner[keep]])
        found.append(key[keep])
        gone = deleting[band][local]
        if gone.any():
            owners.append(some[local[gone]])
            found.append(mixed(total[flat[gone]] - mix[token[gone]] + tag[flat[gone]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(found)


def _described(docs: DataFrame, width: int) -> DataFrame:
    """Size, digest (a, b) and sketch of each text's set; and in rows of their own the frequent shingles of a portion.

    A shingle that over 1/200 of all texts hold has that share in some portion, so each portion reports those it holds.
    """

    def run(batches):
        names = ["shingle", "doc_id", "n", "a", "b", "sketch"]
        for batch in portions(batches, 1):
            sets = shingles(batch.column(1), width)
            a, b = digests(sets)
            data, where = sketches(sets)
            rows = batch.num_rows
            packed = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, bool)), batch.column(0), pa.array(sets.sizes(), pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), packed], names=names)
            value, n = np.unique(sets.values, return_counts=True)
            many = n > max(2, rows / 200)
            value, n = value[many].view(np.int64), n[many].astype(np.int64)
            nothing = [pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), bool)), nothing[0], pa.array(n), pa.array(value), nothing[0], nothing[1]], names=names)

    return docs.mapInArrow(run, "shingle boolean, doc_id long, n long, a long, b long, sketch binary")


def _frequent(described: DataFrame) -> np.ndarray:
    """The FREQUENT most frequent shingles, sorted by hash; they only steer which keys are dropped."""
    counted = described.filter("shingle").groupBy("a").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "a").limit(FREQUENT).select("a").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _keyed(docs: DataFrame, width: int, percent: int, plan: list[Band], frequent: np.ndarray) -> DataFrame:
    """(doc_id, a, b, keys): KEY_BYTES bytes for each key."""

    def run(batches):
        for batch in portions(batches, 1):
            sets = shingles(batch.column(1), width)
            a, b = digests(sets)
            owner, key = keys(sets, plan, percent, frequent)
            order = np.argsort(owner, kind="stable")
            data = key[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()
            ends = offsets(np.cumsum(np.bincount(owner, minlength=batch.num_rows))) * KEY_BYTES
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), packed], names=["doc_id", "a", "b", "keys"])

    return docs.mapInArrow(run, "doc_id long, a long, b long, keys binary")


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def _short(key: np.ndarray) -> np.ndarray:
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]


def _starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and its length."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return at, np.diff(np.append(at, len(key)))


def _dealt(keyed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, docs, keys, more): for each bucket, which the key's low bits give, a batch's keys and their leaders.

    more has a byte for each key, 1 where the leader has members in the batch.  Those members are rows of their own
    with a negative bucket, in which ``more`` holds the leaders.
    """
    names = ["bucket", "docs", "keys", "more"]

    def run(batches):
        for batch in portions(batches, 1, DEALT_BYTES, TASK_ROWS):
            blobs = batch.column(1).to_pylist()
            n = np.array([len(b) // KEY_BYTES for b in blobs], np.int64)
            key = _unpacked(b"".join(blobs))
            doc = np.repeat(batch.column(0).to_numpy(), n)
            order = np.lexsort((mixed(doc.view(np.uint64)), key))
            key, doc = key[order], doc[order]
            at, size = _starts(key)
            leader = np.repeat(doc[at], size)
            rest = np.ones(len(key), bool)
            rest[at] = False
            local = np.flatnonzero(rest)
            for low in range(0, len(local), LOCAL_ROWS):
                part = local[low : low + LOCAL_ROWS]
                own = -1 - int(mixed(key[part[:1]] ^ doc[part[:1]].view(np.uint64))[0] >> np.uint64(34))
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (doc[part], _short(key[part]), leader[part]))], names=names)
            key, doc, more = key[at], doc[at], size > 1
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, key, doc, more = bucket[order], _short(key[order]), doc[order], more[order]
            at, size = _starts(bucket)
            spans = list(zip(at, at + size, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), *(pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (doc, key, more))], names=names)

    return keyed.select("doc_id", "keys").mapInArrow(run, "bucket int, docs binary, keys binary, more binary")


def _grouped(rows: pa.Table) -> pa.Table:
    """The groups of one bucket that have several members: (key, doc_id, leader), as one row for each member.

    The leader is the member that comes first in a hashed order of documents, the same order in all groups and batches.
    Where members of other members are elsewhere the leader has a second row, without a leader, as it has not met all.
    """
    release()
    names = ["key", "doc_id", "leader"]
    key, doc = _unpacked(b"".join(rows["keys"].to_pylist())), np.frombuffer(b"".join(rows["docs"].to_pylist()), np.int64)
    more = b"".join(rows["more"].to_pylist())
    if rows["bucket"][0].as_py() < 0:  # members with their leaders of one batch; their leaders go with them
        leader = np.frombuffer(more, np.int64)
        both = np.unique(np.column_stack([key.view(np.int64), leader]), axis=0)
        return pa.table([pa.array(np.append(x, y)) for x, y in ((key.view(np.int64), both[:, 0]), (doc, both[:, 1]), (leader, both[:, 1]))], names=names)
    more = np.frombuffer(more, np.uint8)
    order = np.lexsort((mixed(doc.view(np.uint64)), key))
    key, doc, more = key[order], doc[order], more[order]
    at, size = _starts(key)
    leader = np.repeat(doc[at], size)
    many = np.repeat(size, size) > 1
    deep = at[(size > 1) & (np.add.reduceat(more, at, dtype=np.int64) > 0)] if len(at) else at
    key = np.append(key[many], key[deep]).view(np.int64)
    led = pa.array(np.append(leader[many], leader[deep]), mask=np.arange(len(key)) >= int(many.sum()))
    return pa.table([pa.array(key), pa.array(np.append(doc[many], doc[deep])), led], names=names)


def _linked(width: int, percent: int):
    def run(key, leaders: pa.Table, members: pa.Table) -> pa.Table:
        """Which members are linked with the leader; rows of the leader's id are one document."""
        release()
        names = ["a", "b"]
        if not len(leaders) or not len(members):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], names=names)
        one, many = shingles(leaders["text"], width), shingles(members["text"], width)
        good = np.zeros(len(members), bool)
        owners, sizes = many.owners(), many.sizes()
        for k in range(len(leaders)):
            own = one.values[one.first[k] : one.first[k + 1]]
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(own, many.values), len(own) - 1)
            both = np.bincount(owners, own[at] == many.values, len(sizes)).astype(np.int64)
            good |= 100 * both >= percent * (len(own) + sizes - both)
        good &= sizes > 0
        doc = members["doc_id"].to_numpy()[good]
        return pa.table([pa.array(np.full(len(doc), key[0].as_py()), pa.int64()), pa.array(doc, pa.int64())], names=names)

    return run


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, tables: Tables, part_bytes: int) -> DataFrame:
    """(a, b) of those pairs (leader, doc_id) that are linked.

    A leader's members are dealt by a hash into parts of about part_bytes of text, and its text is sent to each of these.
    """
    texts = _holding(docs, pairs.select("doc_id").union(pairs.select("leader")).distinct(), tables)
    size = texts.groupBy(F.col("doc_id").alias("s")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    sized = pairs.join(size, F.col("s") == F.col("doc_id"))
    n = sized.groupBy(F.col("leader").alias("l")).agg(F.sum("bytes").alias("bytes"))
    parts = F.ceil((F.col("bytes") + 1) / part_bytes).cast("int")
    members = pairs.join(n, F.col("l") == F.col("leader")).select("leader", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"), "doc_id")
    members = members.join(texts.select(F.col("doc_id").alias("t"), F.col("text").alias("member_text")), F.col("t") == F.col("doc_id"))
    members = members.select(F.col("leader").alias("of"), F.col("part").alias("in"), "doc_id", F.col("member_text").alias("text"))
    leaders = n.join(texts.select(F.col("doc_id").alias("t"), F.col("text").alias("leader_text")), F.col("t") == F.col("l"))
    leaders = leaders.select(F.col("l").alias("leader"), F.col("leader_text").alias("text"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return leaders.groupBy("leader", "part").cogroup(members.groupBy("of", "in")).applyInArrow(_linked(width, percent), "a long, b long")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (leader, doc_id) whose sketches don't rule a link out."""
    one = sets.select(F.col("doc_id").alias("d1"), F.col("n").alias("n1"), F.col("sketch").alias("s1"))
    two = sets.select(F.col("doc_id").alias("d2"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))
    both = pairs.join(one, F.col("d1") == F.col("leader")).join(two, F.col("d2") == F.col("doc_id")).select("leader", "doc_id", "n1", "n2", "s1", "s2")

    def run(batches):
        for batch in portions(batches, 4, TILE_BYTES):
            s1, s2 = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            differ = np.array([differences(folded(x, min(len(x), len(y))), folded(y, min(len(x), len(y)))) for x, y in zip(s1, s2, strict=True)], np.int64)
            keep = may_link(batch.column(2).to_numpy(), batch.column(3).to_numpy(), differ, percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return both.mapInArrow(run, "leader long, doc_id long")


def _crossing(percent: int, limit: int):
    def run(rows):
        """Pairs of members of one key that lie in different components and whose sketches don't rule a link out.

        Of two members the one of the later component reports the pair, and of its pairs the limit most alike; more
        tells that it has others.
        """
        release()
        rows = rows.combine_chunks().sort_by([("key", "ascending"), ("low", "ascending"), ("high", "ascending"), ("component", "ascending")])
        key, low, high, tile, doc, component, n = (rows[c].to_numpy() for c in ("key", "low", "high", "tile", "doc_id", "component", "n"))
        sketch = rows["sketch"].to_pylist()
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        found = []
        for start, stop in zip(first, np.append(first[1:], len(key)), strict=True):
            size = min(len(sketch[k]) for k in range(start, stop))
            bits = np.stack([folded(sketch[k], size) for k in range(start, stop)])
            begins = np.searchsorted(component[start:stop], component[start:stop])
            for k in np.flatnonzero(begins):
                before, own = slice(start, start + begins[k]), start + k
                differ = differences(bits[: begins[k]], bits[k])
                good = may_link(n[before], n[own], differ, percent)
                if low[own] != high[own]:  # pairs within a tile are compared by the tile's own task
                    good &= tile[before] != tile[own]
                at = np.flatnonzero(good)
                more = len(at) > limit
                if more:
                    at = at[np.lexsort((doc[start + at], differ[at]))[:limit]]
                other = doc[start + at]
                found.append(np.column_stack([np.minimum(other, doc[own]), np.maximum(other, doc[own]), np.full(len(at), more, np.int64)]))
        pairs = np.concatenate([np.zeros((0, 3), np.int64), *found])
        return pa.table([pa.array(pairs[:, 0].copy(), pa.int64()), pa.array(pairs[:, 1].copy(), pa.int64()), pa.array(pairs[:, 2] > 0)], names=["leader", "doc_id", "more"])

    return run


def _named(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, F.col("vertex") == F.col("doc_id"), "left").select(*rows.columns, F.coalesce("component", "doc_id").alias("component"))


def _open(groups: DataFrame, found: DataFrame, sets: DataFrame, tables: Tables, tile: int, tile_bytes: int) -> DataFrame:
    """The members of those groups that hold several components but the leaders that met all, in pairs of tiles.

    A group of one tile is one.  In a larger one the members of its largest component, which only have to meet others,
    have tiles of their own, and these meet the tiles of the rest but not each other.
    """
    own = sets.groupBy(F.col("doc_id").alias("d")).agg(F.max("n").alias("n"))  # an id may stand for several sets
    named = _named(groups.filter("leader IS NULL OR doc_id <> leader").select("key", "doc_id"), found).join(own, F.col("d") == F.col("doc_id")).drop("d")
    named = tables.cut(named, "named")
    by_component = named.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("elements"))
    size = F.struct("c", "elements", "component")
    several = by_component.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("components"), F.max(size).alias("major"), F.sum("c").alias("all"), F.sum("elements").alias("all_elements")).filter("components > 1")
    tiles = lambda c, e: F.ceil(F.greatest(c / tile, e / (2 * tile_bytes))).cast("int")  # noqa: E731  a sketch has half a byte for each element, or less
    few = tiles(F.col("all"), F.col("all_elements")) == 1
    several = several.select(
        "k", F.when(few, F.lit(None)).otherwise(F.col("major.component")).alias("major"), F.when(few, 1).otherwise(tiles(F.col("all") - F.col("major.c"), F.col("all_elements") - F.col("major.elements"))).alias("t"),
        F.when(few, 0).otherwise(tiles(F.col("major.c"), F.col("major.elements"))).alias("m"),
    )
    left = named.join(several, F.col("k") == F.col("key"))
    main = F.coalesce(F.col("component") == F.col("major"), F.lit(False))
    left = left.withColumn("tile", F.when(main, F.col("t") + F.pmod(F.xxhash64("doc_id"), "m")).otherwise(F.pmod(F.xxhash64("doc_id"), "t")).cast("int"))
    last = F.when(main, F.col("t")).otherwise(F.col("t") + F.col("m")) - 1
    left = left.select("key", (F.col("t") + F.col("m") == 1).alias("lone"), "tile", F.col("doc_id").alias("id"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    left = left.join(sets.select("doc_id", "n", "sketch"), F.col("doc_id") == F.col("id"))
    return tables.cut(left.select("key", "lone", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "doc_id", "n", "sketch"), "open")


def _closed(links: DataFrame, groups: DataFrame, sets: DataFrame, known: DataFrame, width: int, percent: int, tables: Tables, sizes: Sizes) -> DataFrame:
    """The components of all documents, from those that the links with leaders give.

    In each round a member of an open group is compared with the members of other components that are most alike by
    their sketches, a few at first and then more, until none has any left; most find a link among the first.
    """
    found = components(links)
    left = _open(groups, found, sets, tables, sizes.tile, sizes.tile_bytes)
    tables.drop("named")
    rows, held = left.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("sketch")), F.lit(0))).first()
    parts = max(64, rows // sizes.task, held // sizes.tile_bytes)
    task = F.when(F.col("lone"), F.pmod("key", F.lit(parts))).otherwise(F.xxhash64("key", "low", "high"))
    limit, tried, step = NEAREST, None, 0
    while True:
        named = _named(left, found).withColumn("task", task)
        rest = tables.cut(named.groupBy("task").applyInArrow(_crossing(percent, limit), "leader long, doc_id long, more boolean"), "rest")
        pairs = rest.select("leader", "doc_id").distinct()
        pairs = tables.cut(pairs if tried is None else pairs.join(tried, ["leader", "doc_id"], "left_anti"), f"untried-{step}")
        if pairs.limit(1).count():
            links = links.union(tables.cut(_verified(pairs, known, width, percent, tables, sizes.part), f"links-{step}"))
            found = components(links)
        if not rest.filter("more").limit(1).count():
            tables.drop("open", "rest", "candidates")
            return found
        tried = pairs if tried is None else tried.union(pairs)
        limit, step = limit * 8, step + 1


def _holding(docs: DataFrame, wanted: DataFrame, tables: Tables) -> DataFrame:
    """docs whose id is among wanted (doc_id), in a table.

    A bitmap of 2^23 hash bits, at most 256 rows of 4 KiB, is broadcast to drop most other documents before texts move.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 23))
    marks = wanted.select(bit("doc_id").alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    near = docs.withColumn("bit", bit("doc_id")).join(F.broadcast(marks), F.bitmap_bucket_number("bit") == F.col("bucket"))
    position = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("map", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = near.filter(F.call_function("shiftright", byte, F.pmod(position, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1).select("doc_id", "text")
    return tables.cut(near.join(wanted.select(F.col("doc_id").alias("w")), F.col("w") == F.col("doc_id"), "left_semi"), "candidates")


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id reachable by links from each row, itself included."""
    with small_batches(docs.sparkSession):
        return _joined(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), width, percent, sizes)


def _joined(docs: DataFrame, width: int, percent: int, sizes: Sizes) -> DataFrame:
    tables = Tables(docs.sparkSession)
    known = docs.filter("doc_id IS NOT NULL")
    everything = tables.cut(_described(docs, width), "described")
    described = everything.filter("NOT shingle").select("doc_id", "n", "a", "b")
    largest = described.agg(F.max("n")).first()[0] or 0
    plain = bands(percent, max(1, largest))
    real = described.filter("doc_id IS NOT NULL AND n > 0")
    band = F.size(F.filter(F.array(*[F.lit(b.high) for b in plain]), lambda h: h < F.col("n")))
    counts = dict(real.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect())
    plan = allocate(plain, counts)
    frequent = _frequent(everything)
    buckets = max(64, -(-number_of_keys(plan, counts) * (KEY_BYTES + 9) // sizes.bucket))
    # documents with equal sets: the smallest id stands for all of them
    classes = tables.cut(real.groupBy("a", "b").agg(F.min("doc_id").alias("stands")), "classes")
    own = classes.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "stands")
    standing = (F.col("stands") == F.col("doc_id")) & (F.col("ca") == F.col("a")) & (F.col("cb") == F.col("b"))
    keyed = _keyed(known, width, percent, plan, frequent).join(own, standing, "left_semi")
    groups = tables.cut(_dealt(keyed, buckets).groupBy("bucket").applyInArrow(_grouped, "key long, doc_id long, leader long"), "groups")
    met = groups.select("doc_id").distinct().select(F.col("doc_id").alias("m"))
    sets = everything.filter("NOT shingle").join(own, standing, "left_semi").join(met, F.col("m") == F.col("doc_id"), "left_semi").select("doc_id", "n", "sketch")
    sets = tables.cut(sets, "sketches")
    pairs = tables.cut(_possible(groups.filter("doc_id <> leader").select("leader", "doc_id").distinct(), sets, percent), "pairs")
    links = tables.cut(_verified(pairs, known, width, percent, tables, sizes.part), "links")
    tables.drop("pairs")
    # rows of one id with different sets are one document
    several = real.groupBy("doc_id").agg(F.min("a").alias("x"), F.max("a").alias("y")).filter("x <> y").select(F.col("doc_id").alias("d"))
    same = real.join(several, F.col("d") == F.col("doc_id"), "left_semi").join(own, (F.col("ca") == F.col("a")) & (F.col("cb") == F.col("b"))).select(F.col("doc_id").alias("a"), F.col("stands").alias("b"))
    links = links.union(same)
    found = _closed(links, groups, sets, known, width, percent, tables, sizes)
    tables.drop("groups", "sketches", "links")
    out = described.join(own, (F.col("ca") == F.col("a")) & (F.col("cb") == F.col("b")) & (F.col("n") > 0), "left")
    out = out.join(found, F.col("vertex") == F.col("stands"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "stands", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
