"""Licence scan, lexical search and importance resampling with other settings than their queries', against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from wireloom.llm import importance_resampling, lexical_search, license_scan
from wireloom.llm.importance_resampling import hashes
from wireloom.llm.license_scan import ACCEPT, BASE, NOTICES, SLACK, parsed

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n_words string, matches string, place int, rank int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 7, 8) for r in rows], SCHEMA).repartition(3)


def long_text(rnd: random.Random, n: int) -> str:
    words = [f"w{k}" for k in range(500)] + ["license", "MIT", "version"]
    return " ".join(rnd.choices(words, k=n))


# licence scan


def plain_matches(text):
    words, out = terms(text), Counter()
    stand = lambda phrase, at: at >= 0 and words[at : at + len(phrase)] == phrase
    for label, notice in BASE + NOTICES:
        need, ((place, lead), *more) = parsed(notice)
        for at in range(len(words) - len(lead) + 1):
            if stand(lead, at) and all(any(stand(p, at - place + k + j) for j in range(-SLACK, SLACK + 1)) for k, p in more):
                there = Counter(words[max(0, at - place - SLACK) : at - place + len(need) + SLACK])
                shared = sum(min(n, there[w]) for w, n in Counter(need).items())
                if 100 * shared >= ACCEPT * len(need):
                    out[label, (label, notice) in BASE, at, round(shared / len(need), 9)] += 1
    return out


def test_scan_finds_what_a_plain_scan_finds(spark):
    rnd = random.Random(12)
    filler = "the of this software version 2 0 3 license public general gnu MIT apache and terms".split()
    texts = [None, "", "mit", "MIT LICENSE", "license mit license mit license", long_text(rnd, 900_000) + " released under the MIT-License"]
    for _ in range(120):
        words = rnd.choice(NOTICES)[1].replace("[", "").replace("]", "").split()
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(words) + 1)
            words[at : at + rnd.randrange(2)] = rnd.choices(filler, k=rnd.randrange(3))
        texts.append(rnd.choice([" ", "  ", ", ", "\n"]).join([*rnd.choices(filler, k=rnd.randrange(6)), *words, *rnd.choices(filler, k=rnd.randrange(9)), *words[: rnd.randrange(9)]]).title())
    assert len(texts[5]) > license_scan.PORTION
    docs = table(spark, list(enumerate(texts)))
    found = license_scan.scan(docs, license_scan.index(docs))
    assert found.columns == ["doc_id", "text", "place", "rank", "n_words", "matches"]
    labels = set()
    for r in found.collect():
        got = Counter((m.label, m.base, m.start, round(m.coverage, 9)) for m in r.matches)
        assert (r.n_words, r.text, got) == (len(terms(r.text)), texts[r.doc_id], plain_matches(r.text))
        labels |= {m.label for m in r.matches}
    assert len(labels) > 15


# lexical search


def plain_search(items, docs, k, once):
    split = [(doc_id, terms(text)) for doc_id, text in docs]
    n, total = sum(1 for _, t in split if t), sum(len(t) for _, t in split)
    df = Counter(w for _, t in split for w in set(t))
    out = Counter()
    for item, text in items:
        scores = []
        for doc_id, t in split:
            tf, m = Counter(t), 50 + (50 * len(t) * n) // total
            weight = lambda w: math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
            score = sum((1 if once else times) * weight(w) * ((10**9 * tf[w]) // (1000 * tf[w] + 20 * m)) for w, times in Counter(terms(text)).items() if tf[w])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1):
            out[item, rank, doc_id, -score] += 1
    return out


def test_search_with_repeats_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEMS", 3)
    monkeypatch.setattr(lexical_search, "SALTS", 2)
    rnd = random.Random(2)
    docs = [(k, long_text(rnd, rnd.randrange(1, 60))) for k in range(300)]
    docs += [(None, docs[3][1]), (None, docs[3][1]), (9, docs[3][1]), (400, None), (401, " - "), (402, "Ünï w1 w1 w1"), (403, long_text(rnd, 900_000))]
    items = [(k, " ".join(rnd.choices([f"w{j}" for j in range(500)], k=12))) for k in range(7)] + [(7, docs[3][1] + " " + docs[3][1]), (7, "ünï"), (None, "w1 w1 w2"), (8, None), (9, "nowhere")]
    for k, once in ((4, False), (4, True)):
        got = lexical_search.search(table(spark, items), table(spark, docs), k, once, item_id="doc_id")
        assert Counter(map(tuple, got.collect())) == plain_search(items, docs, k, once)


def test_search_without_items_or_documents(spark):
    none, some = table(spark, [(1, "a b")]).limit(0), table(spark, [(1, "a b")])
    for items, docs in ((none, some), (some, none), (none, none)):
        got = lexical_search.search(items, docs, item_id="doc_id")
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.isEmpty()


# importance resampling


def plain_hashes(text, width):
    words = terms(text)
    return [zlib.crc32(" ".join(words[i - n + 1 : i + 1]).encode()) for i in range(len(words)) for n in range(min(width, i + 1), 0, -1)]


@given(st.text(alphabet="aB9 -\n\té　😀.", max_size=60), st.integers(1, 4), st.integers(1, 9))
@settings(deadline=None, max_examples=150)
def test_ring_gives_the_crc_of_each_run(text, width, piece):
    found = list(hashes(text.encode(), width, piece))
    assert [int(h) for _, part in found for h in part] == plain_hashes(text, width) and sum(n for n, _ in found) == len(terms(text))


def test_resampling_by_pairs_of_words(spark):
    rnd = random.Random(6)
    docs = [(k, long_text(rnd, rnd.randrange(0, 25))) for k in range(200)] + [(None, "w1 w2 w3 w4 w5"), (None, None), (3, "w1 w1 w1 w1 w1 w1"), (3, "w1 w1 w1 w1 w1 w1"), (500, long_text(rnd, 700_000))]
    target = [(k, long_text(rnd, 30) + " w1 w2 w3") for k in range(9)] + [(10, None)]
    width, buckets, seed, least, percent = 2, 97, 5, 6, 30
    count = lambda rows: Counter(h % buckets for _, text in rows for h in plain_hashes(text, width))
    s, t = count(docs), count(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    want = []
    for doc_id, text in docs:
        found = plain_hashes(text, width)
        weight = sum(gain[h % buckets] for h in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        want.append((doc_id, len(terms(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in want if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = order[: len(order) * percent // 100]
    want = Counter((*r, None) for r in want)
    for k, r in enumerate(drawn, 1):
        want[(*r, None)] -= 1
        want[(*r, k)] += 1
    got = importance_resampling.resample(table(spark, docs), table(spark, target), percent, least, width, buckets, seed)
    assert Counter(map(tuple, got.collect())) == +want
