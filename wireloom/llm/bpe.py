"""Byte-level BPE encoding and decoding with a public vocabulary file.

A pre-token is merged with a priority queue of (merge rank, position) over a doubly linked list of symbols; queue
entries whose symbols have changed since are skipped.  Decoding joins the vocabulary's byte strings.  Work is a
narrow map over rows: nothing is shuffled, and a task holds two megabytes of a batch, or one longer text, and a bounded
cache.

Null texts count as empty; empty texts give no ids and decode to an empty text.  Repeated rows give repeated
results, and other columns are passed on unless they have the name of a result, which replaces them.
"""

from __future__ import annotations

import heapq
import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import table
from .words import portions

#: The published pre-token pattern of this vocabulary; white space is the Unicode property.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
TOKENS, WORDS = 300_000, 300_000
#: Marks the first word of a text, which no blank precedes; a text that holds it is cut as a whole.
NO_BLANK = "\ue000"
CACHED_CHARS = 48


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Tokenizer:
    """Encoder and decoder for a byte-level BPE file in the format of the tokenizers library."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in letters.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.first = [vocab[letters[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for s, i in vocab.items():
            self.strings[i] = bytes(value[c] for c in s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.pieces = regex.compile(PRE_TOKEN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = _Cache(self._merged, TOKENS)
        self.words = _Cache(self._word, WORDS)

    def _merged(self, piece: str) -> bytes:
        ids = merge(piece.encode(), self.first, self.merges)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.pieces.findall(text)))

    def _word(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace() or word[0] == NO_BLANK and (len(word) == 1 or word[1].isspace()):
            raise _Unsafe
        return self._whole(" " + word if word[0] != NO_BLANK else word[1:])

    def _plain(self, text: str) -> bytes:
        """A pre-token begins at each blank between two letters that are not white space; other texts are cut as a whole."""
        if NO_BLANK in text:
            return self._whole(text)
        try:
            return b"".join(map(self.words.__getitem__, (NO_BLANK + text).split(" ")))
        except _Unsafe:
            return self._whole(text)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.uint32(self.special[part]).tobytes() if part in self.special else self._plain(part) for part in self.split.split(text) if part)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Unsafe(Exception):
    """White space stands beside a blank, or begins or ends the text."""


class _Cache(dict):
    """Results by text in two generations; long texts are not kept, and a full young generation becomes the old one."""

    def __init__(self, make, size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, text: str) -> bytes:
        out = self.old.get(text)
        if out is None:
            out = self.make(text)
        if len(text) <= CACHED_CHARS:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[text] = out
        return out


def merge(data: bytes, first: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Merge the symbols of data, lowest rank first and leftmost of these, until no pair is left.

    A queue entry is rank << 32 | place of the left symbol; it is stale where the pair at that place now has
    another rank or is gone.
    """
    symbol = [first[b] for b in data]
    n = len(symbol)
    if n == 1:
        return symbol
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    found = merges.get
    queue = [pair[0] << 32 | at for at in range(n - 1) if (pair := found(symbol[at] << 32 | symbol[at + 1]))]
    heapq.heapify(queue)
    while queue:
        entry = heapq.heappop(queue)
        left = entry & 0xFFFFFFFF
        right = after[left]
        a = symbol[left]
        if a < 0 or right >= n:
            continue
        pair = found(a << 32 | symbol[right])
        if pair is None or pair[0] != entry >> 32:
            continue
        symbol[left] = a = pair[1]
        symbol[right] = -1
        after[left] = right = after[right]
        if right < n:
            before[right] = left
            if pair := found(a << 32 | symbol[right]):
                heapq.heappush(queue, pair[0] << 32 | left)
        prior = before[left]
        if prior >= 0 and (pair := found(symbol[prior] << 32 | a)):
            heapq.heappush(queue, pair[0] << 32 | prior)
    return [s for s in symbol if s >= 0]


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    with open(path, encoding="utf-8") as f:
        return Tokenizer(json.load(f))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with the ids of each text in a binary column, 4 bytes an id.

    path: the vocabulary file, which has to be on every machine, as the tokenizers package is.
    """
    path = path or vocabulary()
    return _mapped(df, text, [StructField(ids, BinaryType())], lambda: lambda t: (load(path).encode(t or ""),))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text of each ids column."""
    path = path or vocabulary()
    return _mapped(df, ids, [StructField(text, StringType())], lambda: lambda i: (load(path).decode(i or b""),))


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the ids of each text and the text that they decode to, in one pass of one Python worker."""
    path = path or vocabulary()

    def both():
        tokenizer = load(path)

        def one(t: str | None):
            coded = tokenizer.encode(t or "")
            return coded, tokenizer.decode(coded)

        return one

    return _mapped(df, text, [StructField(ids, BinaryType()), StructField(decoded, StringType())], both)


def _mapped(df: DataFrame, source: str, targets: list[StructField], function) -> DataFrame:
    """df with the target columns, which function() makes from the source; batches are cut by its bytes."""
    names = [t.name for t in targets]
    kept = [c for c in df.columns if c not in names]
    at = df.columns.index(source)
    places = [df.columns.index(c) for c in kept]
    kinds = [pa.binary() if isinstance(t.dataType, BinaryType) else pa.string() for t in targets]

    def run(batches):
        one = function()
        for batch in portions(batches, at, rows=512):
            made = zip(*map(one, batch.column(at).to_pylist()), strict=True)
            made = [pa.array(c, k) for c, k in zip(made, kinds, strict=True)] if batch.num_rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *made], names=[*kept, *names])

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in kept), *targets]))


def op9_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = round_trip(docs)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
