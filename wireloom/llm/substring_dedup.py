"""Substring dedup by super-k-mers: windows of words that start in an earlier document are removed from later ones.

Consecutive windows that share a minimiser, which is the least run of ``PART`` words within the window by a hash order,
travel as one packed string to the bucket of the minimiser; equal windows have equal minimisers, so they meet.  Runs of
words that are very frequent (at most ``2 * HEAVY`` of them, counted first over all texts) come last in the order, so
that no frequent phrase draws unlike windows into one bucket.

    documents --by chunk--> distinct packed strings of the chunk --by bucket--> smallest document of each window
              \\-------------------------- by chunk again <-- windows of the chunk that an earlier document has

A chunk holds about ``CHUNK`` bytes of documents, dealt by hash.  It sends each packed string once, with its smallest
and largest document, so a passage in a third of all documents arrives once from each chunk.  A bucket numbers words
exactly, sorts its windows and compares equal neighbours word by word, and answers each chunk for those strings that
have a window with a smaller document.  The chunk then marks the words of its documents.

Texts that are null or shorter than a window lose nothing.  Rows with a null id lose nothing and remove nothing.  Rows
with one id count as one document.  Words are kept as they are and joined by one blank; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_bytes
from .words import Words, binary, gather, hashes, mixed, offsets, portions, runs, words

WINDOW = 13
PART = 3
CHUNK = 4 << 20
LEAST_CHUNKS = 64
HEAVY = 4000
LONGEST = 40
TOP = np.uint64(1 << 63)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of so many values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def part_hashes(split: Words) -> np.ndarray:
    codes, distinct = split.codes()
    return runs(hashes(distinct)[codes], PART)


def super_kmers(split: Words, heavy: np.ndarray, skip: np.ndarray | None = None):
    """First word, windows, minimiser and text of each super-k-mer.  heavy: sorted; skip: texts to leave out."""
    n = len(split.ends) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    parts = part_hashes(split)
    order = parts >> np.uint64(1)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, parts), len(heavy) - 1)
        order |= np.where(heavy[at] == parts, TOP, np.uint64(0))
    minimiser = least(order, WINDOW - PART + 1)
    text = np.repeat(np.arange(len(split.first) - 1), np.diff(split.first))
    good = text[:n] == text[WINDOW - 1 :]
    if skip is not None:
        good &= ~skip[text[:n]]
    at = np.flatnonzero(good)
    if not len(at):
        return at, at, np.zeros(0, np.uint64), at
    new = np.ones(len(at), bool)
    new[1:] = (minimiser[at[1:]] != minimiser[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    begins = np.flatnonzero(new)
    place = np.arange(len(at)) - begins[np.cumsum(new) - 1]
    begins = np.flatnonzero(place % LONGEST == 0)  # runs of one word repeat their minimiser without end
    starts = at[begins]
    return starts, np.diff(np.append(begins, len(at))), minimiser[starts], text[starts]


def frequent(docs: DataFrame, text: str) -> np.ndarray:
    """The runs of PART words that make up over 1/HEAVY of all, sorted; at most 2 * HEAVY of them.

    A run above that share has at least half of it in some portion of texts, so portions report no others.
    """

    def run(batches):
        for batch in portions(batches, 0, CHUNK):
            found, n = np.unique(part_hashes(words(batch.column(0))), return_counts=True)
            many = n > max(1, n.sum() / (2 * HEAVY))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found[many].view(np.int64), 0)), pa.array(np.append(n[many], 0).astype(np.int64)), pa.array(np.append(np.zeros(many.sum()), n.sum()).astype(np.int64))], names=["part", "n", "of"])

    counted = docs.select(text).mapInArrow(run, "part long, n long, of long").groupBy("part").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    total = counted.agg(F.sum("of")).first()[0] or 0
    rows = counted.filter((F.col("n") > 1) & (F.col("n") > total / (2 * HEAVY))).select("part").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


class Chunk:
    """The packed strings of a chunk's documents; the same documents give the same strings in the same order."""

    def __init__(self, rows: pa.Table, heavy: np.ndarray, buckets: int):
        rows = rows.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc = rows["doc_id"]
        known = self.doc.is_valid().to_numpy(zero_copy_only=False)
        ids = self.doc.fill_null(0).to_numpy()
        self.split = words(rows["text"])
        self.starts, self.counts, minimiser, text = super_kmers(self.split, heavy, ~known)
        self.ids = ids[text]
        begins = offsets(self.split.ends)[self.starts]
        lengths = self.split.ends[self.starts + self.counts + WINDOW - 2] - begins
        packed = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets(np.cumsum(lengths))), pa.py_buffer(self.split.data[gather(begins, lengths)])])
        coded = packed.dictionary_encode()
        codes, self.strings = coded.indices.to_numpy(), coded.dictionary
        n = len(self.strings)
        first = np.zeros(n, np.int64)
        last = np.zeros(n, np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        last[codes] = np.arange(len(codes))
        bucket = (mixed(minimiser[first]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.entry = place[codes]  # of each super-k-mer
        self.order, self.lowest, self.highest, self.windows = order, self.ids[first][order], self.ids[last][order], self.counts[first][order]
        self.buckets, at = np.unique(bucket[order], return_index=True)
        self.bounds = np.append(at, n)

    def sent(self):
        """A blob for each bucket."""
        strings = self.strings.take(pa.array(self.order))
        data, where = binary(strings)
        for k, b in enumerate(self.buckets):
            low, high = self.bounds[k], self.bounds[k + 1]
            yield int(b), packed_entries(np.diff(where[low : high + 1]), self.windows[low:high], self.lowest[low:high], self.highest[low:high], data[where[low] : where[high]])

    def kept(self, answers) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Number of words, number removed and kept words of each document.  answers: (bucket, blob)."""
        n = len(self.order)
        at, told = np.full(n, -1, np.int64), []
        total = 0
        for b, blob in answers:
            k = int(np.searchsorted(self.buckets, b))
            entry, smallest = unpacked_answer(blob)
            entry = entry + self.bounds[k]
            count = self.windows[entry]
            at[entry] = total + np.cumsum(count) - count
            total += int(count.sum())
            told.append(smallest)
        split = self.split
        edges = np.zeros(len(split.ends) + 1, np.int32)
        if told:
            smallest = np.concatenate(told)
            hit = np.flatnonzero(at[self.entry] >= 0)
            count = self.counts[hit]
            gone = smallest[gather(at[self.entry[hit]], count)] < np.repeat(self.ids[hit], count)
            begin = gather(self.starts[hit], count)[gone]
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + WINDOW, -1)
        keep = np.cumsum(edges[:-1]) <= 0
        before = offsets(np.cumsum(~keep))
        removed = np.diff(before[split.first])
        length = np.diff(offsets(split.ends))
        stay = np.repeat(keep, length)
        kept_words = np.flatnonzero(keep)
        text = np.repeat(np.arange(len(split.first) - 1), np.diff(split.first))[kept_words]
        final = kept_words[np.append(text[1:] != text[:-1], True)] if len(kept_words) else kept_words
        stay[split.ends[final] - 1] = False  # no blank after a text's last word
        size = offsets(np.cumsum(stay))
        ends = size[offsets(split.ends)[split.first]]
        kept = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(split.data[stay])])
        return np.diff(split.first), removed, kept


def packed_entries(lengths, windows, lowest, highest, data) -> bytes:
    body = b"".join([np.array([len(lengths)], "<u4").tobytes(), lengths.astype("<u4").tobytes(), windows.astype("u1").tobytes(), lowest.astype("<i8").tobytes(), highest.astype("<i8").tobytes(), data.tobytes()])
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpacked_entries(blob: bytes):
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(body, "<u4", 1)[0])
    return np.frombuffer(body, "u1", n, 4 + 4 * n).astype(np.int64), np.frombuffer(body, "<i8", n, 4 + 5 * n), np.frombuffer(body, "<i8", n, 4 + 13 * n), np.frombuffer(body, np.uint8, offset=4 + 21 * n)


def unpacked_answer(blob: bytes):
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(body, "<u4", 1)[0])
    return np.frombuffer(body, "<u4", n, 4).astype(np.int64), np.frombuffer(body, "<i8", offset=4 + 4 * n)


def smallest_documents(codes: np.ndarray, begin: np.ndarray, document: np.ndarray) -> np.ndarray:
    """For each window, which is WINDOW codes from a place on, the smallest document of the windows equal to it."""
    key = runs(mixed(codes.astype(np.uint64) + np.uint64(1)), WINDOW)[begin]
    order = np.argsort(key, kind="stable")
    at = begin[order]
    equal = np.flatnonzero(key[order][1:] == key[order][:-1])
    same = np.ones(len(equal), bool)
    for j in range(WINDOW):
        same &= codes[at[equal] + j] == codes[at[equal + 1] + j]
    if not same.all():  # unlike windows with one hash: number all windows by their words
        _, key = np.unique(codes[begin[:, None] + np.arange(WINDOW)], axis=0, return_inverse=True)
        key = key.ravel()
        order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    lowest = np.minimum.reduceat(document[order], first)
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(lowest, np.diff(np.append(first, len(key))))
    return out


def answered(rows: pa.Table) -> pa.Table:
    """One bucket: the answers to the chunks that sent to it."""
    names = ["chunk", "bucket", "blob"]
    sent = [unpacked_entries(b) for b in rows["blob"].to_pylist()]
    sizes = [len(s[0]) for s in sent]
    windows, lowest, highest = (np.concatenate([s[k] for s in sent]) for k in range(3))
    data = np.concatenate([s[3] for s in sent])
    ends = np.flatnonzero(data == 32) + 1
    codes, _ = Words(data, ends, np.zeros(1, np.int64)).codes()
    length = windows + WINDOW - 1
    begin = gather(np.cumsum(length) - length, windows)
    smallest = smallest_documents(codes, begin, np.repeat(lowest, windows))
    first = np.cumsum(windows) - windows
    told = np.minimum.reduceat(smallest, first) < highest
    chunk, out, low = rows["chunk"].to_pylist(), [], 0
    compress = zstandard.ZstdCompressor(level=1).compress
    for c, n in zip(chunk, sizes, strict=True):
        entry = np.flatnonzero(told[low : low + n])
        if len(entry):
            body = np.array([len(entry)], "<u4").tobytes() + entry.astype("<u4").tobytes() + smallest[gather(first[low + entry], windows[low + entry])].astype("<i8").tobytes()
            out.append((c, rows["bucket"][0].as_py(), compress(body)))
        low += n
    cols = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=names)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words that stay, joined by one blank."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = max(LEAST_CHUNKS, -(-text_bytes(docs, "text") // CHUNK))
    heavy = frequent(docs, "text")
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def send(rows: pa.Table) -> pa.Table:
        chunk = rows["chunk"][0].as_py()
        sent = list(Chunk(rows.select(["doc_id", "text"]), heavy, n).sent())
        return pa.table([pa.array([chunk] * len(sent), pa.int32()), pa.array([b for b, _ in sent], pa.int32()), pa.array([x for _, x in sent], pa.binary())], names=["chunk", "bucket", "blob"])

    def mark(rows: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "text"]
        if not len(rows):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names=names)
        chunk = Chunk(rows.select(["doc_id", "text"]), heavy, n)
        total, removed, kept = chunk.kept(zip(answers["bucket"].to_pylist(), answers["blob"].to_pylist(), strict=True))
        return pa.table([chunk.doc, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), kept.cast(pa.string())], names=names)

    schema = "chunk int, bucket int, blob binary"
    sent = dealt.groupBy("chunk").applyInArrow(send, schema)
    answers = sent.groupBy("bucket").applyInArrow(answered, schema)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(mark, "doc_id long, n_words long, n_removed long, text string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))
