"""Token ids in files of fixed-width blocks.

Each id takes the fewest bits that hold the vocabulary, so numpy unpacks a block, or any range of ids in it, without
a loop.  A store is a folder of shards in ascending order of document id.  A shard is a run of blocks and one footer:

    block   "WLB1" bits:u1 0:u1 0:u2 documents:u4 ids:u8 | doc_id:i8 * documents | has_id:u1 * documents |
            length:u4 * documents | ids packed most significant bit first
    footer  "WLF1" blocks:u4 | first byte:u8 * blocks | ids before:u8 * blocks
    both are followed by the separator; the last 12 bytes before a shard's final separator are the footer's length:u8
    and "WLE1"

Integers are little-endian.  Spark's text sink writes the records, with the separator as its line end, so shards are
committed once however often tasks rerun.

Null texts count as empty.  Every document ends with the end id, so empty texts have one id.  Null ids come first;
rows with equal ids are ordered by their content, so reruns agree.  Other columns are not stored.
"""

from __future__ import annotations

import os
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import cut, scratch, table, text_bytes
from .words import gather, portions, words

SEPARATOR = "\nWLX1\n"
BLOCK, FOOTER, END = b"WLB1", b"WLF1", b"WLE1"
BLOCK_IDS = 1 << 18
SHARD_BYTES = 24 << 20
LEAST_BYTES = 1 << 20
#: Bytes of text that a task encodes at once.
PORTION = 8 << 20
END_ID = 1
#: The ids of the default vocabulary file.
VOCABULARY = 49_408
CACHE = 600_000
LETTERS = byte_letters()


def width(vocabulary: int) -> int:
    """Bits that hold the ids below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids, each in so many bits, most significant bit first; the last byte is filled up with zeros.

    An id that so many bits don't hold is an error.
    """
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits: the vocabulary is larger than stated")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    places = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> places) & 1).astype(np.uint8)).tobytes()


def unpack(data, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a packed run; only their own bytes are touched."""
    if bits in (8, 16, 32):
        step = bits // 8
        return np.frombuffer(data, f">u{step}", stop - start, start * step).astype("<u4")
    first = start * bits // 8
    flat = np.unpackbits(np.frombuffer(data, np.uint8, (stop * bits + 7) // 8 - first, first))[start * bits - first * 8 :][: (stop - start) * bits]
    return (flat.reshape(-1, bits).astype(np.uint32) << np.arange(bits - 1, -1, -1, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


def narrow(vocabulary: int) -> int:
    """Bytes of an id on its way to a store."""
    return 2 if width(vocabulary) <= 16 else 4


def as_binary(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary value for each run of ids."""
    ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]) * ids.itemsize, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, ends.buffers()[1], pa.py_buffer(ids.tobytes())])


def block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    head = BLOCK + bytes([bits, 0, 0, 0]) + np.array([len(doc_ids)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    known = [d is not None for d in doc_ids]
    return head + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(known) + np.array(lengths, "<u4").tobytes() + pack(ids, bits)


def footer(starts: list[int], before: list[int]) -> bytes:
    body = FOOTER + np.array([len(starts)], "<u4").tobytes() + np.array(starts, "<u8").tobytes() + np.array(before, "<u8").tobytes()
    return body + np.array([len(body) + 12], "<u8").tobytes() + END


class Shard:
    """Random access to one shard."""

    def __init__(self, data: bytes):
        tail = len(data) - len(SEPARATOR)
        if data[tail - 4 : tail] != END:
            raise ValueError("the shard has no footer")
        length = int(np.frombuffer(data, "<u8", 1, tail - 12)[0])
        n = int(np.frombuffer(data, "<u4", 1, tail - length + 4)[0])
        self.data = data
        self.starts = np.frombuffer(data, "<u8", n, tail - length + 8).astype(np.int64)
        self.before = np.frombuffer(data, "<u8", n, tail - length + 8 + 8 * n).astype(np.int64)

    def head(self, k: int):
        """Of block k: bits, number of ids, document ids, lengths, place of the packed ids."""
        at = int(self.starts[k])
        if self.data[at : at + 4] != BLOCK:
            raise ValueError(f"no block at byte {at}")
        bits, docs, ids = self.data[at + 4], int(np.frombuffer(self.data, "<u4", 1, at + 8)[0]), int(np.frombuffer(self.data, "<u8", 1, at + 12)[0])
        at += 20
        doc_ids, known, lengths = np.frombuffer(self.data, "<i8", docs, at), np.frombuffer(self.data, "u1", docs, at + 8 * docs), np.frombuffer(self.data, "<u4", docs, at + 9 * docs)
        return bits, ids, doc_ids, known, lengths.astype(np.int64), at + 13 * docs

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard, from the blocks that hold them."""
        out = []
        k = max(0, int(np.searchsorted(self.before, start, "right")) - 1)
        while k < len(self.starts) and self.before[k] < stop:
            bits, n, _, _, _, at = self.head(k)
            low, high = max(0, start - int(self.before[k])), min(n, stop - int(self.before[k]))
            if high > low:
                out.append(unpack(memoryview(self.data)[at:], bits, low, high))
            k += 1
        return np.concatenate(out) if out else np.empty(0, "<u4")

    def documents(self):
        """(document ids, known, first id, ids) of each document, by block."""
        for k in range(len(self.starts)):
            bits, n, doc_ids, known, lengths, at = self.head(k)
            ends = np.cumsum(lengths)
            yield doc_ids, known, ends - lengths + self.before[k], lengths, unpack(memoryview(self.data)[at:], bits, 0, n)


class WordEncoder:
    """The ids of whole texts from a tokenizer of the tokenizers library that drops white space.

    Such a tokenizer never joins what white space divides, so each distinct word of a portion of texts is given to the
    library once and kept while the bounded cache has room.  A final point or comma after an ASCII letter or digit is
    a token of its own, so it is looked up by itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.tails = {t: np.array(self.library.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in (b".", b",")}

    def _learn(self, new: list[bytes]) -> None:
        """Words of letters below U+0130 are their own normal form in lower case and one pre-token, so the library's model takes them as they are."""
        known, rest, tokenize = self.known, [], self.library.model.tokenize
        for word in new:
            stem = word[:-1] if word[-1:] in b".," and word[-2:-1].isalnum() else word
            text = stem.decode()
            if text.isalpha() and (text.isascii() or max(text) < "\u0130"):
                low = text.lower().encode()
                ids = known.get(low)
                if ids is None:
                    tokens = tokenize(low.decode("latin-1").translate(LETTERS))
                    known[low] = ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
                known[word] = ids if stem is word else ids + self.tails[word[-1:]]
            else:
                rest.append(word)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for word, e in zip(part, self.library.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[word] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by end_id, and the number of each text's ids."""
        split = words(texts)
        codes, distinct = split.codes()
        found = [w[:-1] for w in distinct.to_pylist()]
        if len(self.known) > CACHE:
            self.known.clear()
        self._learn([w for w in found if w not in self.known])
        coded = list(map(self.known.__getitem__, found))
        length = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), "<u4")
        counts = length[codes]
        ids = flat[gather((np.cumsum(length) - length)[codes], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[split.first]
        return np.insert(ids, ends[1:], np.uint32(end_id)), np.diff(ends) + 1


@lru_cache(maxsize=2)
def load(path: str) -> WordEncoder:
    return WordEncoder(path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(batches, path: str, end_id: int):
    """(document ids, ids, lengths) of each portion of the batches (doc_id, text): each whole text's ids and the end id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder = load(path)
    for batch in portions(batches, 1, PORTION, 16384):
        yield batch.column(0).cast(pa.int64()), *encoder.encode(batch.column(1), end_id)


def encode(df: DataFrame, path: str | None = None, size: int = VOCABULARY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): each whole text's ids and the end id as little-endian integers of ``narrow(size)`` bytes."""
    path = path or vocabulary()
    step = narrow(size)

    def run(batches):
        for docs, ids, lengths in encoded(batches, path, end_id):
            if step == 2 and len(ids) and int(ids.max()) >> 16:
                raise ValueError(f"id {int(ids.max())} is none of {size}")
            yield pa.RecordBatch.from_arrays([docs, as_binary(ids.astype(f"<u{step}"), lengths)], names=["doc_id", "ids"])

    return df.select(doc_id, text).mapInArrow(run, "doc_id long, ids binary")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, size: int = VOCABULARY, shard_bytes: int = SHARD_BYTES, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of docs (doc_id, text) under path, as shards of about so many bytes of text.

    Texts are dealt to shards by ranges of doc_id, whose bounds Spark samples, sorted there, then encoded and packed in
    one map; small tables get a shard for each core, of LEAST_BYTES at least.  Rows with one id share a shard.
    size: ids of the tokenizer.
    """
    bits = width(size)
    tokenizer = tokenizer or vocabulary()
    separator = len(SEPARATOR.encode())
    n_bytes = text_bytes(docs, "text")
    shards = max(1, -(-n_bytes // shard_bytes), min(docs.sparkSession.sparkContext.defaultParallelism, n_bytes // LEAST_BYTES))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id")

    def run(batches):
        starts, before, place, total = [], [], 0, 0
        docs, lengths, held, n = [], [], [], 0
        for some, ids, counts in encoded(batches, tokenizer, END_ID):
            at = 0
            for doc, count in zip(some.to_pylist(), counts.tolist(), strict=True):
                docs.append(doc)
                lengths.append(count)
                held.append(ids[at : at + count])
                at += count
                n += count
                if n >= block_ids:
                    record = block(docs, lengths, np.concatenate(held), bits)
                    starts, before, place, total = [*starts, place], [*before, total], place + len(record) + separator, total + n
                    docs, lengths, held, n = [], [], [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["record"])
        if docs:
            record = block(docs, lengths, np.concatenate(held), bits)
            starts, before = [*starts, place], [*before, total]
            yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["record"])
        if starts:
            yield pa.RecordBatch.from_arrays([pa.array([footer(starts, before)], pa.binary())], names=["record"])

    packed = dealt.sortWithinPartitions("doc_id", "text").mapInArrow(run, "record binary")
    packed.select(F.col("record").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, first, n_tokens, ids) of every document of a store; first counts within the shard."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                if not len(data.as_buffer()):
                    continue
                for doc_ids, known, first, lengths, ids in Shard(data.as_buffer().to_pybytes()).documents():
                    docs = pa.array(doc_ids, pa.int64(), mask=known == 0)
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(docs), pa.string()), docs, pa.array(first, pa.int64()), pa.array(lengths, pa.int64()), as_binary(ids, lengths)], names=["shard", "doc_id", "first", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "content").mapInArrow(run, "shard string, doc_id long, first long, n_tokens long, ids binary")


def with_starts(stored: DataFrame) -> DataFrame:
    """stored with ``start``: the ids of all documents before, over all shards.  The window has a row for each shard."""
    shards = stored.groupBy("shard").agg(F.min("doc_id").alias("lowest"), F.max(F.col("doc_id").isNull()).alias("nulls"), F.sum("n_tokens").alias("n"))
    order = Window.orderBy(F.col("nulls").desc(), "lowest").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select(F.col("shard").alias("at"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return stored.join(before, F.col("shard") == F.col("at")).drop("at").withColumn("start", F.col("before") + F.col("first")).drop("before")


def op7_token_store(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch(spark, "store")
    write(docs, path)
    stored = cut(read(spark, path).select("shard", "doc_id", "first", "n_tokens", F.crc32("ids").alias("ids_crc32")), "read")
    return with_starts(stored).select("doc_id", "start", "n_tokens", "ids_crc32")
