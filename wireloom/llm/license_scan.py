"""Licence scan: a positional index of licence notices, looked up by each file's rarest licence words.

A template is a notice as words; bracketed runs are its mandatory key phrases, the first of which leads.  The index
holds, for each key phrase, its two words of the highest IDF (over all texts) with their places in it.  A file's
occurrences of such words are looked up from the rarest on; postings of a phrase that agree in relative position
give its candidate starts, where the whole phrase is verified.  A template stands where its lead does, if each other
key phrase stands within ``SLACK`` words of its place, and if of its words, repeats counted, ``ACCEPT`` percent or
more are among the file's words there (``SLACK`` more on either side).  A match can hence not be missed whatever the
IDF: they only decide what is looked up first.

The words are runs of digits, letters and anything beyond ASCII, with A-Z in lower case.  Null and empty texts have no
words and no matches.  Rows are scanned alone, so repeated rows, ids and ties do not matter; a place is reported for
each template that stands there.  Other columns are kept; ``n_words`` and ``matches`` replace columns of these names.
An empty table gives an empty one.  A text is held whole by one task, at about 40 times its bytes.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import portions, terms

SLACK = 6
ACCEPT = 80
PORTION = 4 << 20
#: Phrases and the labels that they give wherever they stand.
BASE = [
    ("mit", "[mit license]"),
    ("apache", "[apache license]"),
    ("gpl", "[general public license]"),
]
#: Usual notices of licences, in their own words.
NOTICES = [
    ("mit-notice", "released under the [mit license]"),
    ("mit-notice", "licensed under the [mit license]"),
    ("mit-grant", "[permission is hereby granted] free of charge to any person obtaining a copy of this software and associated documentation files the software to [deal in the software without restriction]"),
    ("apache-2.0", "licensed under the [apache license] [version 2 0]"),
    ("apache-2.0", "[apache license] [version 2 0] january 2004"),
    ("gpl-2.0", "licensed under the gnu [general public license] [version 2]"),
    ("gpl-3.0", "licensed under the gnu [general public license] [version 3]"),
    ("gpl-2.0", "under the terms of the gnu [general public license] as published by the free software foundation either [version 2] of the license"),
    ("gpl-3.0", "under the terms of the gnu [general public license] as published by the free software foundation either [version 3] of the license"),
    ("agpl-3.0", "under the terms of the gnu [affero general public license] as published by the free software foundation either [version 3] of the license"),
    ("lgpl-2.1", "under the terms of the gnu [lesser general public license] as published by the free software foundation either [version 2 1] of the license"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "[neither the name of] the copyright holder nor the names of its contributors may be used to [endorse or promote products derived from this software]"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "subject to the terms of the [mozilla public license] [v 2 0]"),
    ("cc-by-4.0", "licensed under a [creative commons attribution] [4 0] international license"),
    ("cc-by-nc-4.0", "licensed under [cc by nc 4 0]"),
    ("all-rights-reserved", "[all rights reserved]"),
    ("unlicense", "this is [free and unencumbered software] released into the [public domain]"),
    ("boost-1.0", "distributed under the [boost software license] [version 1 0]"),
    ("epl-2.0", "under the terms of the [eclipse public license] [v 2 0]"),
]


class Phrase(NamedTuple):
    at: int  # its first word's place in the template
    words: tuple[int, ...]


class Template(NamedTuple):
    label: str
    base: bool
    words: tuple[int, ...]
    phrases: tuple[Phrase, ...]


class Index(NamedTuple):
    vocabulary: pa.Array  # the templates' distinct words, each with a blank
    templates: tuple[Template, ...]
    idf: np.ndarray  # of each word of the vocabulary


def parsed(text: str) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """A notice's words, and its bracketed phrases with their places."""
    words, phrases, inside = [], [], None
    for word in text.replace("[", " [ ").replace("]", " ] ").split():
        if word == "[":
            inside = len(words)
        elif word == "]":
            phrases.append((inside, words[inside:]))
        else:
            words.append(word)
    if not phrases:
        raise ValueError(f"no key phrase in {text!r}")
    return words, phrases


def templates(base=BASE, notices=NOTICES) -> tuple[pa.Array, tuple[Template, ...]]:
    read = [(label, kind, *parsed(text)) for kind, group in ((True, base), (False, notices)) for label, text in group]
    vocabulary = sorted({word for _, _, words, _ in read for word in words})
    code = {word: k for k, word in enumerate(vocabulary)}
    coded = lambda words: tuple(code[w] for w in words)
    return pa.array([f"{w} ".encode() for w in vocabulary], pa.large_binary()), tuple(
        Template(label, kind, coded(words), tuple(Phrase(at, coded(p)) for at, p in phrases)) for label, kind, words, phrases in read
    )


def _known(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each word's place in the vocabulary, or -1, and the first word of each text."""
    split = terms(texts)
    codes, distinct = split.codes()
    place = pc.fill_null(pc.index_in(distinct, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    return (place[codes] if len(codes) else np.zeros(0, np.int32)), split.first


def index(docs: DataFrame, text: str = "text", base=BASE, notices=NOTICES) -> Index:
    """The templates with the IDF of their words over all texts: one count for each word comes to the driver."""
    vocabulary, made = templates(base, notices)
    n = len(vocabulary)

    def count(batches):
        total = np.zeros(n + 1, np.int64)
        for part in portions(batches, 0, PORTION):
            places, first = _known(part.column(0), vocabulary)
            of = np.repeat(np.arange(part.num_rows), np.diff(first))[places >= 0]
            total[:n] += np.bincount(np.unique(of * n + places[places >= 0]) % n, minlength=n)
            total[n] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(total)], names=["word", "n"])

    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word long, n long")
    df = np.zeros(n + 1)
    for word, held in counts.groupBy("word").agg(F.sum("n")).collect():
        df[word] = held
    return Index(vocabulary, made, np.log((df[n] + 1) / (df[:n] + 0.5)))


class _Portion:
    """The licence words of some texts, by word and place, and where phrases stand."""

    def __init__(self, texts: pa.Array, found: Index):
        self.index = found
        self.words, self.first = _known(texts, found.vocabulary)
        at = np.flatnonzero(self.words >= 0)
        self.at = at[np.argsort(self.words[at], kind="stable")]
        self.bounds = np.searchsorted(self.words[self.at], np.arange(len(found.vocabulary) + 1))
        self.starts: dict[tuple[int, ...], np.ndarray] = {}

    def places(self, word: int) -> np.ndarray:
        return self.at[self.bounds[word] : self.bounds[word + 1]]

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1

    def stands(self, phrase: tuple[int, ...]) -> np.ndarray:
        """Ascending starts of the phrase within a text."""
        if phrase not in self.starts:
            rare = sorted(range(len(phrase)), key=lambda k: -self.index.idf[phrase[k]])
            found = self.places(phrase[rare[0]]) - rare[0]
            if len(rare) > 1 and len(found):
                found = np.intersect1d(found, self.places(phrase[rare[1]]) - rare[1], assume_unique=True)
            found = found[(found >= 0) & (found + len(phrase) <= len(self.words))]
            for k in rare[2:]:
                found = found[self.words[found + k] == phrase[k]]
            self.starts[phrase] = found[self.text_of(found) == self.text_of(found + len(phrase) - 1)]
        return self.starts[phrase]

    def matches(self, template: Template) -> tuple[np.ndarray, np.ndarray]:
        """Where the template stands (the lead's start), and how many of its words are there."""
        lead = self.stands(template.phrases[0].words)
        text = self.text_of(lead)
        low, high = self.first[text], self.first[text + 1]
        begin = lead - template.phrases[0].at
        ok = np.ones(len(lead), bool)
        for phrase in template.phrases[1:]:
            starts = self.stands(phrase.words)
            a, b = np.maximum(begin + phrase.at - SLACK, low), np.minimum(begin + phrase.at + SLACK + 1, high)
            ok &= np.searchsorted(starts, b) > np.searchsorted(starts, a)
        lead, begin, low, high = lead[ok], begin[ok], low[ok], high[ok]
        a, b = np.maximum(begin - SLACK, low), np.minimum(begin + len(template.words) + SLACK, high)
        shared = np.zeros(len(lead), np.int64)
        for word in set(template.words):
            places = self.places(word)
            shared += np.minimum(np.searchsorted(places, b) - np.searchsorted(places, a), template.words.count(word))
        ok = 100 * shared >= ACCEPT * len(template.words)
        return lead[ok], shared[ok]


MATCH = "template int, label string, base boolean, start long, coverage double"
_ARROW = pa.struct([("template", pa.int32()), ("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("coverage", pa.float64())])


def scan(docs: DataFrame, found: Index, text: str = "text") -> DataFrame:
    """docs with ``n_words`` and ``matches``: template, label, whether a base phrase, the lead's first word, coverage."""
    own = "wireloom_text"
    kept = [c for c in docs.columns if c not in ("n_words", "matches", own)]
    slim = docs.select(*kept, F.col(text).cast("string").alias(own))
    out_schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.select(*kept).schema)}, n_words long, matches array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>"
    labels = pa.array([t.label for t in found.templates], pa.string())
    bases = pa.array([t.base for t in found.templates], pa.bool_())

    def run(batches):
        for part in portions(batches, len(kept), PORTION):
            words = _Portion(part.column(len(kept)), found)
            starts, which, coverage = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
            for k, template in enumerate(found.templates):
                lead, shared = words.matches(template)
                starts.append(lead)
                which.append(np.full(len(lead), k, np.int32))
                coverage.append(shared / len(template.words))
            start, template, covered = map(np.concatenate, (starts, which, coverage))
            order = np.lexsort((template, start))
            start, template, covered = start[order], template[order], covered[order]
            text_of = words.text_of(start)
            rows = pa.StructArray.from_arrays(
                [pa.array(template), labels.take(pa.array(template)), bases.take(pa.array(template)), pa.array(start - words.first[text_of]), pa.array(covered)], fields=list(_ARROW)
            )
            offsets = pa.array(np.searchsorted(text_of, np.arange(part.num_rows + 1)).astype(np.int32))
            made = [*part.columns[: len(kept)], pa.array(np.diff(words.first)), pa.ListArray.from_arrays(offsets, rows)]
            yield pa.RecordBatch.from_arrays(made, names=[*kept, "n_words", "matches"])

    return slim.mapInArrow(run, out_schema)


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs.select("doc_id", "text"), index(docs))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    joined = lambda matches: F.array_join(F.sort_array(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
    notices = F.array_max(F.transform(F.filter("matches", lambda m: ~m["base"]), lambda m: m["coverage"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.coalesce(notices, F.when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def _values() -> str:
    rows = []
    for k, (kind, label, text) in enumerate([(True, *t) for t in BASE] + [(False, *t) for t in NOTICES]):
        words, phrases = parsed(text)
        for j, (at, phrase) in enumerate(phrases):
            rows.append(f"({k}, '{label}', {kind}, {json.dumps(words)}, {j}, {at}, {json.dumps(phrase)})".replace('"', "'"))
    return ",\n  ".join(rows)


OP11_SQL = rf"""
WITH t(tid, label, base, tw, j, place, phrase) AS (VALUES
  {_values()}
), d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), w AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d
), f AS (
  SELECT DISTINCT phrase FROM t
), hit AS (
  SELECT w.rid, w.i, f.phrase FROM w JOIN f ON w.w = f.phrase[1] JOIN d ON d.rid = w.rid WHERE d.ws[w.i + 1:w.i + len(f.phrase)] = f.phrase
), lead AS (
  SELECT hit.rid, hit.i, t.* FROM hit JOIN t ON t.phrase = hit.phrase AND t.j = 0
), rest AS (
  SELECT lead.rid, lead.i, lead.tid, count(DISTINCT t.j) AS n
  FROM lead JOIN t ON t.tid = lead.tid AND t.j > 0 JOIN hit ON hit.rid = lead.rid AND hit.phrase = t.phrase AND abs(hit.i - (lead.i - lead.place + t.place)) <= {SLACK} GROUP BY ALL
), need AS (
  SELECT tid, max(j) AS n FROM t GROUP BY tid
), ok AS (
  SELECT lead.* FROM lead JOIN need USING (tid) LEFT JOIN rest ON rest.rid = lead.rid AND rest.i = lead.i AND rest.tid = lead.tid WHERE coalesce(rest.n, 0) = need.n
), tc AS (
  SELECT tid, x, count(*) AS n FROM (SELECT DISTINCT tid, tw FROM t) t2, unnest(tw) AS u(x) GROUP BY ALL
), seen AS (
  SELECT ok.rid, ok.i, ok.tid, w.w AS x, count(*) AS n FROM ok JOIN w ON w.rid = ok.rid AND w.i >= ok.i - ok.place - {SLACK} AND w.i < ok.i - ok.place + len(ok.tw) + {SLACK} GROUP BY ALL
), cov AS (
  SELECT seen.rid, seen.i, seen.tid, sum(least(seen.n, tc.n)) AS shared FROM seen JOIN tc ON tc.tid = seen.tid AND tc.x = seen.x GROUP BY ALL
), m AS (
  SELECT ok.rid, ok.i, ok.label, ok.base, CAST(cov.shared AS DOUBLE) / len(ok.tw) AS coverage FROM ok JOIN cov ON cov.rid = ok.rid AND cov.i = ok.i AND cov.tid = ok.tid
  WHERE 100 * cov.shared >= {ACCEPT} * len(ok.tw)
), s AS (
  SELECT rid, count(*) FILTER (base) AS n, min(i) FILTER (base) AS low, max(i) FILTER (base) AS high, max(coverage) FILTER (NOT base) AS c,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS al FROM m GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word,
       coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, CAST(coalesce(c, CASE WHEN n > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score
FROM d LEFT JOIN s USING (rid)
"""
