"""Quality classifier: a byte-level convolutional network in numpy.

A filter sums learned weights of the ``WIDTH`` bytes at a place, so a convolution is a sum of table rows.  Responses
at every ``STRIDE``-th byte of the whole text are max-pooled within chunks of ``2 * HALF`` bytes that overlap by half;
a hidden layer reads each chunk's pooled responses and its fill, and the mean and the maximum of the hidden units over
all chunks are combined into one probability.  The cost is linear in the bytes, and a task holds a megabyte of texts or
one longer text.

``fit`` trains on at most ``SAMPLE`` labelled rows of ``SAMPLE_BYTES`` in all, whole texts chosen by a hash of their id,
none of over ``SAMPLE_TEXT`` bytes; nothing but the text is an input.  Scoring reads every whole text.

Null and empty texts have no chunk: all pooled values are 0, and their score is what the last layer gives these.
Rows with a null id are scored and are never held out or learned from.  Rows whose label is null are not learned from;
where an id has several labels the smallest holds.  Without any label of either class the score is 0.5 throughout.
Other columns of the input are kept by ``score``; ``quality_score`` is replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import table
from .words import portions

WIDTH, STRIDE, HALF = 6, 2, 128
FILTERS, HIDDEN = 16, 16
#: Labelled rows to learn from, bytes of one of them and of all, at most.
SAMPLE, SAMPLE_TEXT, SAMPLE_BYTES = 4000, 1 << 20, 48 << 20
ROUNDS = 20
ACCEPT = 0.3
FOLDS = 5


class Network(NamedTuple):
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS + 1 x HIDDEN
    hidden_bias: np.ndarray
    last: np.ndarray  # 2 * HIDDEN
    last_bias: np.ndarray


def layout(texts: list[bytes]):
    """The texts, each filled up to whole halves and divided by WIDTH zero bytes, and what of them belongs where.

    Returns the bytes, the number of halves of each text and the bytes in each half.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    halves = -(-lengths // HALF)
    data = b"".join(t.ljust(int(h) * HALF, b"\0") for t, h in zip(texts, halves, strict=True))
    fill = np.full(int(halves.sum()), HALF, np.int64)
    ends = np.cumsum(halves)
    some = halves > 0
    fill[ends[some] - 1] = lengths[some] - (halves[some] - 1) * HALF
    return np.frombuffer(data + b"\0" * WIDTH, np.uint8), halves, fill


def responses(net: Network, data: np.ndarray, start: int, halves: int) -> np.ndarray:
    """halves x places x FILTERS, before the nonlinearity."""
    places = np.arange(start, start + halves * HALF, STRIDE)
    out = net.filters[0].take(data[places], 0)
    for j in range(1, WIDTH):
        out += net.filters[j].take(data[places + j], 0)
    return out.reshape(halves, HALF // STRIDE, FILTERS)


def pooled(net: Network, data: np.ndarray, n: int, places: bool = False):
    """Maximum response of each filter in each half, and where it is if asked."""
    best = np.empty((n, FILTERS), np.float32)
    at = np.empty((n, FILTERS), np.int64) if places else None
    for low in range(0, n, 64):
        high = min(n, low + 64)
        r = responses(net, data, low * HALF, high - low)
        if places:
            k = r.argmax(1)
            at[low:high] = k * STRIDE + (np.arange(low, high) * HALF)[:, None]
            best[low:high] = np.take_along_axis(r, k[:, None], 1)[:, 0]
        else:
            best[low:high] = r.max(1)
    return best, at


def chunks(best: np.ndarray, halves: np.ndarray, fill: np.ndarray):
    """Of each chunk, which is a half and the next of its text: pooled responses, fill, text, and whether the next half wins."""
    doc = np.repeat(np.arange(len(halves)), halves)
    n = len(doc)
    following = np.zeros(n, bool)
    if n:
        following[:-1] = doc[:-1] == doc[1:]
    lone = np.repeat(halves, halves) == 1
    use = following | lone  # the last half of a longer text is part of the chunk before
    second = np.where(following, np.arange(n) + 1, np.arange(n))[use]
    a, b = best[use], best[second]
    return np.maximum(a, b), ((fill[use] + np.where(following[use], fill[second], 0)) / (2 * HALF)).astype(np.float32), doc[use], b > a, np.flatnonzero(use), second


def forward(net: Network, best, halves, fill):
    top, full, doc, wins, one, two = chunks(best, halves, fill)
    inputs = np.column_stack([np.maximum(top + net.bias, 0), full])
    hidden = np.maximum(inputs @ net.hidden + net.hidden_bias, 0)
    n = len(halves)
    count = np.bincount(doc, minlength=n)
    some = np.flatnonzero(count)
    mean, most = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(count[some])[:-1]])
        mean[some] = np.add.reduceat(hidden, starts) / count[some][:, None]
        most[some] = np.maximum.reduceat(hidden, starts)
    logit = np.column_stack([mean, most]) @ net.last + net.last_bias[0]
    return logit, (inputs, hidden, doc, count, mean, most, wins, one, two)


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    data, halves, fill = layout(texts)
    best, _ = pooled(net, data, len(fill))
    logit, _ = forward(net, best, halves, fill)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(np.float64)))


def gradients(net: Network, texts: list[bytes], labels: np.ndarray, weights: np.ndarray):
    data, halves, fill = layout(texts)
    best, at = pooled(net, data, len(fill), True)
    logit, (inputs, hidden, doc, count, mean, most, wins, one, two) = forward(net, best, halves, fill)
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    d = ((p - labels) * weights / weights.sum()).astype(np.float32)
    both = np.column_stack([mean, most])
    g_last, g_last_bias = both.T @ d, np.array([d.sum()], np.float32)
    g_hidden = (d[:, None] * net.last[:HIDDEN])[doc] / np.maximum(count[doc], 1)[:, None]
    ties = (hidden == most[doc]) & (hidden > 0)
    share = np.maximum(_sums(ties.astype(np.float32), doc, len(halves)), 1)
    g_hidden += ties * ((d[:, None] * net.last[HIDDEN:]) / share)[doc]
    g_hidden *= hidden > 0
    g_w, g_wb = inputs.T @ g_hidden, g_hidden.sum(0)
    g_in = (g_hidden @ net.hidden.T)[:, :FILTERS] * (inputs[:, :FILTERS] > 0)
    place = np.where(wins, at[two], at[one])
    g_filters = np.empty_like(net.filters)
    unit = np.arange(FILTERS)
    for j in range(WIDTH):
        key = data[place + j].astype(np.int64) * FILTERS + unit
        g_filters[j] = np.bincount(key.ravel(), g_in.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return Network(g_filters, g_in.sum(0), g_w, g_wb, g_last, g_last_bias)


def _sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), np.float32)
    np.add.at(out, doc, values)
    return out


def train(texts: list[bytes], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Network | None:
    """Adam on the weighted log loss, in which either class has half the weight."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(normal(0.4, WIDTH, 256, FILTERS), np.zeros(FILTERS, np.float32), normal(0.35, FILTERS + 1, HIDDEN), np.full(HIDDEN, 0.1, np.float32), normal(0.3, 2 * HIDDEN), np.zeros(1, np.float32))
    first, second, step = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], 0
    weights = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    size = 48
    rounds = max(rounds, -(-400 // max(1, len(texts) // size)))  # few rows are passed more often
    total = rounds * -(-len(texts) // size)
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), size):
            part = order[low : low + size]
            grad = gradients(net, [texts[i] for i in part], labels[part], weights[part])
            step += 1
            rate = 0.01 * (1 - step / (total + 1)) + 0.0005
            for w, g, m, v in zip(net, grad, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Network | None:
    """Train on at most ``sample`` rows of those that are not held out.  The driver gets these rows, up to SAMPLE_BYTES, and no others."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.select(F.col("doc_id").alias("wireloom_id"), "quality").orderBy(F.xxhash64("wireloom_id"), "wireloom_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("wireloom_id") == F.col("doc_id"))
    # where rows share an id, one of them is learned from
    one = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    total = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the sample's rows
    got = one.withColumn("wireloom_total", total).filter(F.col("wireloom_total") <= SAMPLE_BYTES).select("doc_id", "quality", "text").toPandas().sort_values("doc_id")
    return train([(t or "").encode() for t in got["text"]], got["quality"].to_numpy(np.int64))


def score(docs: DataFrame, net: Network | None, text: str = "text", name: str = "quality_score") -> DataFrame:
    """docs with the probability of a good text."""
    kept = [c for c in docs.columns if c != name]
    places = [docs.columns.index(c) for c in kept]
    at = docs.columns.index(text)

    def run(batches):
        for batch in portions(batches, at, 1 << 20, 512):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            made = np.full(len(texts), 0.5) if net is None else scores(net, [t or b"" for t in texts])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(made, pa.float64())], names=[*kept, name])

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in kept), StructField(name, DoubleType())]))


def op6_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, net).select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
