"""Parts of the operators against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wireloom.llm import bpe, embedding_dedup, jaccard_join, line_dedup, mixing, quality_model, quality_rules, token_store, warc
from wireloom.llm.words import words

from brute import WORD, brute_components


SMALL = jaccard_join.Sizes(bucket=3000, part=700, tile=5, tile_bytes=900, task=12)
ALLOCATIONS = {
    "by cost": jaccard_join.allocate,
    "exact": lambda plain, counts: plain,
    "deletions": lambda plain, counts: [b._replace(segments=(b.differ + 2) // 2, drop=0, deletions=True) for b in plain],
}


@pytest.mark.parametrize(
    ("width", "percent", "sizes", "allocation"),
    [(4, 85, jaccard_join.Sizes(), "by cost"), (5, 80, SMALL, "by cost"), (4, 85, SMALL, "exact"), (5, 80, SMALL, "deletions")],
)
def test_jaccard_join_of_near_copies(spark, monkeypatch, width, percent, sizes, allocation):
    """Copies drift apart from each other, so that groups stay open after the leader is compared.

    With small sizes there are many buckets, parts of a leader's members, tiles of a group and tasks.
    """
    monkeypatch.setattr(jaccard_join, "allocate", ALLOCATIONS[allocation])
    rnd = random.Random(width)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for size, copies, edits in ((60, 90, 5), (25, 60, 2), (200, 60, 16), (9, 40, 1), (3, 20, 1)):
        base = [rnd.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randrange(edits + 1)):
                w[rnd.randrange(size)] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    rows += [(None, rows[0][1]), (5, rows[100][1]), (2000, None), (2001, " "), (2002, rows[3][1].upper())]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width, percent, sizes=sizes)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows, width, percent)


@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\rabÄ  x", max_size=30), max_size=8))
@settings(deadline=None, max_examples=60)
def test_words_are_those_of_the_pattern(texts):
    import pyarrow as pa

    split = words(pa.array(texts, pa.string()))
    ends = [0, *split.ends.tolist()]
    every = [bytes(split.data[a : b - 1]).decode() for a, b in zip(ends, ends[1:], strict=False)]
    assert [every[a:b] for a, b in zip(split.first, split.first[1:], strict=False)] == [WORD.findall(t) for t in texts]


@given(st.lists(st.integers(0, 49_407), max_size=80), st.integers(16, 20), st.data())
@settings(deadline=None, max_examples=60)
def test_packed_ids_are_read_from_anywhere(ids, bits, data):
    packed = token_store.pack(np.array(ids, np.uint32), bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    low = data.draw(st.integers(0, len(ids)))
    high = data.draw(st.integers(low, len(ids)))
    assert token_store.unpack(packed, bits, low, high).tolist() == ids[low:high]


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet="ab 's\n 　.,1é", max_size=40))
@settings(deadline=None, max_examples=150)
def test_bpe_is_the_library(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = bpe.load(path), Tokenizer.from_file(path)
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
    assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_of_either_version(version):
    bodies = [b"", b"\n\nhttp://x 0.0.0.0 1 text/html 5\n", b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)), b"x" * 5000]
    image = warc.arc_head(version, "a.arc", "20240102030405") + b"".join(warc.arc_record(version, "http://h/ä b", "20240102030405", "text/html", b, k) + b"\n" * (k % 2) for k, b in enumerate(bodies))
    records = list(warc.parse_arc(image))
    assert [r.content for r in records] == bodies and {r.url for r in records} == {"http://h/%C3%A4%20b"} and {r.version for r in records} == {version}
    head, block = warc.parse_warc(warc.to_warc(records[2], "k"))
    assert block == bodies[2] and head["warc-type"] == "response" and head["warc-date"] == "2024-01-02T03:04:05Z" and head["warc-record-id"] == warc.record_id("k")
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_arc(image[:-200]))
    with pytest.raises(ValueError, match="version block"):
        list(warc.parse_arc(b"http://x 0.0.0.0 1 text/html 0\n\n"))


def test_splitting_tree_spends_each_quota():
    quotas = np.array([0, 1, 7, 1000, 33])
    totals = mixing.balanced(1041, 16)
    out = mixing.split(quotas, totals, np.random.default_rng(1))
    assert (out >= 0).all() and (out.sum(0) == quotas).all() and (out.sum(1) == totals).all() and np.ptp(totals) <= 1


def test_mix_repeats_documents_and_keeps_their_columns(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    mixed = mixing.mix(docs).cache()
    assert set(docs.columns) - set(mixing.RESULTS) <= set(mixed.columns)
    assert mixed.filter(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) != F.col("words")).count() == 0
    assert mixed.agg(F.sum("words")).first()[0] == mixing.quotas(docs).agg(F.sum("taken")).first()[0]


def test_shards_draw_disjoint_blocks_of_each_source(spark):
    """Each use is in one shard, and a shard's share of a source is that of a draw without replacement."""
    rows = [(k, " ".join(["w"] * (1 + k % 7)), f"s{min(k % 9, 4)}", k) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard long")
    mixed = mixing.mix(docs, shards=8, blocks=2000, block_documents=5).select("doc_id", "source", "copy", "shard", "words").collect()
    assert len({(r.doc_id, r.copy) for r in mixed}) == len(mixed) and {r.shard for r in mixed} == set(range(8))
    by_source, by_both = Counter(), Counter()
    for r in mixed:
        by_source[r.source] += r.words
        by_both[r.source, r.shard] += r.words
    total, in_shard = sum(by_source.values()), Counter()
    for (s, k), n in by_both.items():
        in_shard[k] += n
        blocks = by_source[s] / 20  # a block has about 20 words
        assert abs(n - by_source[s] / 8) < 6 * 20 * (blocks / 8) ** 0.5 + 60, (s, k, n)
    assert max(in_shard.values()) - min(in_shard.values()) < 0.25 * total / 8  # shards have equal numbers of blocks, of unequal words
    assert [tuple(r) for r in mixing.mix(docs, shards=8, blocks=2000, block_documents=5).select("doc_id", "source", "copy", "shard", "words").sort("doc_id", "copy").collect()] == sorted(map(tuple, mixed), key=lambda r: (r[0], r[2]))


def test_shards_exist_where_blocks_have_no_words(spark):
    rows = [(k, "one two three" if k % 37 == 0 else None, "A") for k in range(1200)] + [(5000 + k, "x", "B") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share in (0.002, 0.4, 1.5):
        got = mixing.quotas(docs, share=share, shards=16, block_documents=2).collect()
        assert {k for r in got for k in r.shards} <= set(range(16))
        aims = {r.source: r.target for r in got}
        taken = Counter()
        for r in got:
            taken[r.source] += r.taken
            assert r.taken <= 2 * r.size and len(r.shards) == -(-r.taken // max(1, r.size))
        assert all(abs(taken[s] - aims[s]) <= 3 for s in aims)


def test_what_no_shard_draws_is_not_taken(spark, hard, monkeypatch):
    """The tree decides: uses beyond the shards' numbers are left out."""
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    real = mixing.drawn
    monkeypatch.setattr(mixing, "drawn", lambda planned, shards, seed: real(planned, shards, seed).filter("shard <> 3"))
    less = mixing.quotas(docs).agg(F.sum("taken")).first()[0]
    monkeypatch.undo()
    full = mixing.quotas(docs)
    assert less == full.agg(F.sum("taken")).first()[0] - mixing.mix(docs).filter("shard = 3").agg(F.sum("words")).first()[0]


def test_written_mix_is_by_shard_with_all_columns(spark, hard, tmp_path):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    mixing.written(docs, shards=4, file_bytes=40_000).write.parquet(str(tmp_path / "mix"))
    got = spark.read.parquet(str(tmp_path / "mix"))
    assert got.columns == docs.columns
    mixed = mixing.mix(docs, shards=4)
    assert Counter(map(tuple, got.select("doc_id", "text", "source").collect())) == Counter(map(tuple, mixed.select("doc_id", "text", "source").collect()))
    own = {(r.doc_id, r.source): (r.size, r.target, r.words, r.lang) for r in docs.collect()}
    assert all(own[r.doc_id, r.source] == (r.size, r.target, r.words, r.lang) for r in got.collect())
    assert len(list((tmp_path / "mix").glob("part-*"))) > 4


def test_line_dedup_thresholds(spark):
    """Nine sites are too few, ten are enough, and the exact count decides near the threshold."""
    rows = [(k, f"nine\nten\n own {k} \n\n", f"s{k if k < 9 else 8 if k < 12 else 9}") for k in range(12)]
    rows += [(50, "ten", "s9"), (51, None, None), (52, " ten\r", "s0")]
    got = {r.doc_id: (r.text, r.wireloom_removed) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == (rows[0][1], 0) and got[3] == ("nine\n own 3 \n\n", 1) and got[50] == ("", 1) and got[51] == (None, 0) and got[52] == ("", 1)


def test_ledger_ablation(spark):
    texts = ["good words " + " ".join(f"word{k}" for k in range(30)), "few", "", None, "A B C", "### " * 30]
    entries = quality_rules.ledger(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).cache()
    rows = [r.failures for r in entries.collect()]
    mask = quality_rules.POLICIES["v1"]
    for r in quality_rules.ablation(entries).collect():
        bit = quality_rules.BIT[r.rule]
        assert r.failed == sum(bool(f & bit) for f in rows)
        assert r.failed_alone == sum((f & mask) == bit for f in rows)
        assert r.passed_without == sum(not f & mask & ~bit for f in rows)


def test_network_gradients_are_those_of_differences():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, n, np.uint8)) for n in (0, 5, 130, 700)]
    labels, weights = np.array([1, 0, 1, 0]), np.ones(4)
    normal = lambda *shape: rng.normal(0, 0.5, shape).astype(np.float32)
    net = quality_model.Network(normal(quality_model.WIDTH, 256, quality_model.FILTERS), normal(quality_model.FILTERS), normal(quality_model.FILTERS + 1, quality_model.HIDDEN), normal(quality_model.HIDDEN), normal(2 * quality_model.HIDDEN), normal(1))

    def loss():
        p = quality_model.scores(net, texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = quality_model.gradients(net, texts, labels, weights)
    for w, g in zip((net.last, net.hidden, net.bias), (grads.last, grads.hidden, grads.bias), strict=True):
        flat, at = w.reshape(-1), int(np.abs(g).argmax())
        keep, step = flat[at], 2e-3
        flat[at] = keep + step
        high = loss()
        flat[at] = keep - step
        low = loss()
        flat[at] = keep
        assert abs((high - low) / (2 * step) - g.reshape(-1)[at]) < 0.02 * max(0.1, abs(g.reshape(-1)[at]))


def test_maps_keep_nested_columns_and_very_long_texts(spark):
    """Fields whose names hold blanks pass through, and one text may be longer than a portion."""
    from pyspark.sql import types as T

    row = T.StructType([T.StructField("a b", T.IntegerType()), T.StructField("c:d", T.ArrayType(T.StringType()))])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("own field", row)])
    long = "Lorem ipsum, dolor sit. " * 150_000
    rows = [(1, long, (7, ["x"])), (2, None, None), (3, "a b", (8, None))]
    docs = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    assert all(got[d].decoded == (t or "") and got[d]["own field"] == (None if f is None else T.Row("a b", "c:d")(*f)) for d, t, f in rows)
    scored = quality_model.score(docs, None)
    assert scored.columns == ["doc_id", "text", "own field", "quality_score"] and scored.count() == 3


def test_archive_files_hold_their_bytes(spark, hard, tmp_path):
    """The text sink writes gzip members as they are."""
    import gzip

    warc.write(spark.read.parquet(f"{hard}/pages.parquet"), str(tmp_path / "warc"))
    heads = []
    for path in (tmp_path / "warc").glob("part-*"):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, body = warc.parse_warc(data)
            heads.append(head)
            data = data[data.index(b"\r\n\r\n") + 4 + len(body) + 4 :]
    assert len(heads) == spark.read.parquet(f"{hard}/pages.parquet").count()
    assert all(h["warc-record-id"] for h in heads)


def test_fit_holds_few_bytes(spark, monkeypatch):
    """The sample is bounded in bytes as well, by whole texts."""
    rows = [(k, ("good text " if k % 2 else "bad ## ") * (2000 if k < 4 else 3)) for k in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    held = []
    monkeypatch.setattr(quality_model, "SAMPLE_TEXT", 1000)
    monkeypatch.setattr(quality_model, "SAMPLE_BYTES", 700)
    monkeypatch.setattr(quality_model, "train", lambda texts, labels: held.extend(texts))
    quality_model.fit(docs, labels)
    assert 500 < sum(map(len, held)) <= 700 and {t.decode() for t in held} <= {t for _, t in rows[4:]}


def brute_links(vectors, cosine=0.95):
    v = np.array([x for _, x in vectors])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= cosine
    np.fill_diagonal(near, False)
    label = np.array([k for k, _ in vectors])
    while True:
        new = np.minimum(label, np.where(near, label[None], label.max()).min(1))
        if (new == label).all():
            return Counter((k, int(n), int(c), bool(k == c)) for (k, _), n, c in zip(vectors, near.sum(1), label, strict=True))
        label = new


@pytest.mark.parametrize(("kind", "cells", "tile"), [("clusters", 24, 16), ("clusters", None, 32), ("random", 40, 16), ("random", None, None)])
def test_embedding_links_over_many_cells(spark, kind, cells, tile):
    """No link is lost where near vectors lie in different cells and tiles."""
    rng = np.random.default_rng(len(kind) + (cells or 0))
    if kind == "clusters":
        base = rng.normal(size=(30, 8))
        made = base[rng.integers(0, 30, 700)] + rng.normal(0, 0.13, (700, 8))
    else:
        made = rng.normal(size=(600, 6))
        made = np.concatenate([made, made[:100] + rng.normal(0, 0.2, (100, 6))])
    vectors = [(int(k) * 3 % 997, x.tolist()) for k, x in enumerate(made)]
    got = embedding_dedup.links(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3), cells=cells, tile=tile)
    want = brute_links(vectors)
    assert sum(n > 0 for _, n, _, _ in want) > 100
    assert Counter(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == want


def test_cells_grow_with_clustered_vectors():
    """Where cells rule others out, more vectors get more cells; among vectors without structure they don't."""
    rng = np.random.default_rng(3)
    sharp = rng.normal(size=(300, 16))[rng.integers(0, 300, 6000)] + rng.normal(0, 0.05, (6000, 16))
    sharp /= np.linalg.norm(sharp, axis=1, keepdims=True)
    few, many = (len(embedding_dedup.cheapest(sharp, n, 0.95, 8192)) for n in (10_000, 10_000_000))
    assert few < many
    flat = rng.normal(size=(4000, 64))
    flat /= np.linalg.norm(flat, axis=1, keepdims=True)
    assert [len(embedding_dedup.cheapest(flat, n, 0.95, 8192)) for n in (10_000, 50_000)] == [8, 8]


@pytest.mark.parametrize(("shard_bytes", "block_ids"), [(2000, 300), (40_000, 1 << 18)])
def test_token_store_of_many_shards_and_blocks(spark, hard, tmp_path, shard_bytes, block_ids):
    """The rows of one shard and one block come out whatever the sizes; a shard gives any range of its ids."""
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    rows = {}
    for name, sizes in (("one", (1 << 40, 1 << 40)), ("many", (shard_bytes, block_ids))):
        path = f"file://{tmp_path}/{name}"
        token_store.write(docs.coalesce(1), path, shard_bytes=sizes[0], block_ids=sizes[1])
        stored = token_store.with_starts(token_store.read(spark, path))
        rows[name] = sorted(map(tuple, stored.select("start", "n_tokens", "doc_id", "ids").collect()), key=lambda r: r[0])
        files = stored.select("shard").distinct().count()
        assert files == 1 if name == "one" else files > 3
    assert rows["many"] == rows["one"]
    ids = np.concatenate([np.frombuffer(r[3], "<u4") for r in rows["one"]])
    at = 0
    for file in sorted(p for p in (tmp_path / "many").iterdir() if p.name.startswith("part-") and p.stat().st_size):
        shard = token_store.Shard(file.read_bytes())
        n = sum(int(lengths.sum()) for _, _, _, lengths, _ in shard.documents())
        assert shard.ids(n // 3, n // 2).tolist() == ids[at + n // 3 : at + n // 2].tolist()
        at += n
    assert at == len(ids)
