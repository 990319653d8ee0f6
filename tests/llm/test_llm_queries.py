"""Every query of the subpackage on hard and empty tables, against SQL or a brute-force version."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from compared import of_duckdb, of_spark
from wireloom.llm.registry import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, hard, name):
    assert of_spark(QUERIES[name](spark, hard)) == of_duckdb(hard, ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def documents(spark, sf_dir):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def library(name: str) -> Tokenizer:
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_op9_is_the_library(spark, hard):
    tok = library("byte_bpe_50k.json")
    want = Counter()
    for doc_id, text, _ in documents(spark, hard):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = QUERIES["op9_bpe_round_trip"](spark, hard).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("where", ["hard", "/root/testdata/sf0.001"])
def test_op7_is_the_library_in_order(spark, hard, where):
    where = hard if where == "hard" else where
    tok = library("word_bpe_49k.json")
    rows = []
    for doc_id, text, _ in documents(spark, where):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        rows.append((doc_id is not None, doc_id or 0, len(ids), zlib.crc32(ids.tobytes()), ids.astype("<u2").tobytes()))
    rows.sort(key=lambda r: (r[0], r[1], r[4]))
    start, want = 0, Counter()
    for known, doc_id, n, crc, _ in rows:
        want[doc_id if known else None, start, n, crc] += 1
        start += n
    assert Counter(map(tuple, QUERIES["op7_token_store"](spark, where).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


@pytest.mark.parametrize("where", ["hard", "/root/testdata/sf0.01"])
def test_op2_meets_its_targets(spark, hard, where):
    where = hard if where == "hard" else where
    docs = documents(spark, where)
    by_source = defaultdict(int)
    for _, text, source in docs:
        by_source[source] += len(WORD.findall(text or ""))
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(by_source.values()), set(order)
    while True:  # capped sources leave, the rest share what is left by weight
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * by_source[s]}
        if not above:
            break
        target |= {s: 2.0 * by_source[s] for s in above}
        left -= sum(2 * by_source[s] for s in above)
        open_ -= above
    target |= {s: level * weight[s] for s in open_}
    run = lambda: sorted(map(tuple, QUERIES["op2_mixing"](spark, where).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    got = run()
    source_of = defaultdict(set)
    for doc_id, text, source in docs:
        source_of[doc_id, len(WORD.findall(text or ""))].add(source)
    assert len(got) == len(docs) and run() == got
    taken = defaultdict(int)
    for doc_id, size, source_size, aim, n in got:
        s = [s for s in source_of[doc_id, size] if by_source[s] == source_size and abs(target[s] - aim) < 1e-6 * max(1, aim)]
        assert s and 0 <= n <= 2 * size
        taken[s[0] if len(s) == 1 else None if None in s else s[0]] += n
    assert abs(sum(taken.values()) - sum(target.values())) <= 40 * len(order)


def test_op6_learns_what_labels_say(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op6_quality_model"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    known = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in known if y == 1], [s for s, y in known if y == 0]
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.85, area
    assert np.mean([s >= 0.3 for s in good]) > 0.9


def test_op6_hard_rows(spark, hard):
    rows = QUERIES["op6_quality_model"](spark, hard).collect()
    assert len(rows) == len(documents(spark, hard)) and all(0 <= r.score <= 1 for r in rows)
