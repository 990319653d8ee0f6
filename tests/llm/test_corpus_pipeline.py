"""Each stage of the pipeline on hard and empty tables, against what it should keep."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brute import brute_components
from wireloom.llm import quality_model

STAGES = dict(corpus_pipeline.STAGES)


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_stages_keep_the_columns(spark, hard, empty):
    for sf_dir in (hard, empty):
        docs = docs_of(spark, sf_dir)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            assert k == 4 or out.columns == docs.columns or set(docs.columns) - set(out.columns) == set()
            assert sf_dir == hard or out.count() == 0


def test_quality_drops_what_the_model_rejects(spark, hard):
    docs = docs_of(spark, hard)
    net = quality_model.fit(docs, spark.read.parquet(f"{hard}/labels.parquet"))
    want = Counter()
    for r in docs.collect():
        if net is None or quality_model.scores(net, [(r.text or "").encode()])[0] >= 0.3:
            want[r.doc_id, r.text] += 1
    assert rows_of(STAGES["quality classifier"](spark, docs, hard), "doc_id", "text") == want


def test_lines_shared_by_sites_go(spark, hard):
    docs = docs_of(spark, hard)
    got = STAGES["line dedup"](spark, docs, hard)
    rows = docs.collect()
    sites, first = {}, {}
    for r in rows:
        for line in {x.strip(" \t\r\x0b\x0c") for x in (r.text or "").split("\n")} - {""}:
            sites.setdefault(line, set()).add(r.source)
            if r.doc_id is not None:
                first[line] = min(first.get(line, r.doc_id), r.doc_id)
    bad = {x for x, s in sites.items() if len(s) >= 10}
    assert bad
    keep = lambda r: None if r.text is None else "\n".join(x for x in r.text.split("\n") if not ((y := x.strip(" \t\r\x0b\x0c")) in bad and first.get(y) != r.doc_id))
    assert rows_of(got, "doc_id", "text") == Counter((r.doc_id, keep(r)) for r in rows)
    assert got.filter("text IS NOT NULL AND n_chars <> length(text)").count() == 0


def test_one_of_each_group_stays(spark, hard):
    docs = docs_of(spark, hard)
    known = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    stay = {d for d, _, c in known if d == c}
    assert {r.doc_id for r in STAGES["n-gram Jaccard join"](spark, docs, hard).collect()} == stay


def test_encoded_texts_come_back(spark, hard):
    docs = docs_of(spark, hard)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = STAGES["BPE encoding and decoding"](spark, docs, hard)
    want = Counter((r.doc_id, np.array(tok.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in docs.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in got.collect()) == want
    assert got.filter(~F.col("round_trip")).count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"] and got.count() > 0
