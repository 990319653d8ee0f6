"""Small tables of hard cases: nulls, empty and long texts, ties, repeated rows and names that clash."""

from __future__ import annotations

import random

CLASH = ["n", "s", "b", "key", "part", "passes", "block", "size", "target", "failures", "component", "chunk", "label", "words"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
BENCHMARK = "item_id long, text string"
PAGES, EMBEDDINGS, LABELS = "page_id long, url string, html string", "vec_id long, embedding array<float>, label int", "doc_id long, quality int, toxic int"


def texts(rnd: random.Random, n: int) -> list[str]:
    vocabulary = [f"{rnd.choice('abcdefgh')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}{k}" for k in range(400)]
    out = []
    for k in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 90))]
        if k % 3 == 1 and out:
            words = out[-1].split()
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        lines = ["Shared line at the head"] * (k % 5 == 0) + [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)] + ["\tcopyright notice "] * (k % 4 == 0)
        out.append("\n".join(lines))
    return out


def documents(n: int = 120) -> list[tuple]:
    rnd = random.Random(9)
    made = texts(rnd, n)
    rows = [(k * 7 % 1000, t, "en", f"site{k % 14}", len(t)) for k, t in enumerate(made)]
    long = " ".join(rnd.choice("lorem ipsum dolor sit amet consectetur adipiscing elit".split()) for _ in range(9000))
    rows += [(2001, None, "en", "site1", 0), (2002, "", None, None, None), (2003, " \t\r\n\x0b\x0c", "en", None, 6), (2004, "word", "en", "site2", 4), (2005, "The Shared line at the head", None, None, None)]
    rows += [(2006, long, "en", "site3", len(long)), (2007, long, "en", "site4", len(long)), (2008, "same " * 60, "en", "site5", 300), (2009, "ÄÖÜ ß é \U0001f600 <|endoftext|> 's   x y", "de", "site6", 30)]
    notice = "Licensed under the Apache License, Version 2.0"
    rows += [(2010, f"{notice}. Released under the MIT-License! mit licensed; mit, license {notice}", "en", "site8", 1), (2011, "GNU general Public license v. 3 mit", "en", "site8", 1), (2012, "license", "en", "site8", 1)]
    rows += [(2013, "Permission is hereby granted, free of charge, to anybody obtaining a copy of the software and documentation files (the software) so as to deal in the Software without any restriction", "en", "site8", 1)]
    rows += [(2014, "this work is licensed under GNU the general public license (the version 3) all rights reserved MIT\nLICENSE mit license", "en", "site8", 1)]
    rows += [rows[4], rows[4], (rows[4][0], rows[9][1], "en", "other", 1), (None, rows[10][1], "en", "site1", 1), (None, None, None, None, None), (-5, rows[11][1], "en", "site7", 1)]
    return rows


def clashing(spark, rows, schema: str):
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH) if c not in df.columns])


def folder(spark, path, empty: bool = False) -> str:
    docs = documents()
    page = "<html>" + "x" * 200
    pages = [(3, "http://a b/", page), (1, None, page), (2, "", page), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "v", "short"), (None, "w", page), (None, "w", "é" * 80), (8, "w", "HTTP/1.1 200\r\n\r\nContent-Length: 5\r\n\r\n" * 4), (8, "x", page), (3, "http://a b/", page)]
    rnd = random.Random(4)
    base = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(25)]
    vectors = [(k, [x + rnd.gauss(0, 0.12) for x in base[k % 25]], k % 3) for k in range(150)]
    vectors += [(500, None, 1), (501, [], 1), (502, [0.0] * 6, 1), (503, [float("nan")] * 6, 1), (504, [float("inf"), *[1.0] * 5], 1), (505, [None, *[1.0] * 5], 1), (None, base[0], 1), (506, base[0], None), (506, base[0], None), (507, [1e-30 * x for x in base[0]], 1)]
    labels = [(r[0], int("Shared" not in (r[1] or "")), 0) for r in docs if r[0] is not None] + [(None, 1, 0), (7, None, 0), (999999, 1, 1)]
    items = [(1, "Shared line at the head"), (1, "Shared line at the head"), (2, docs[3][1]), (3, None), (4, " ,. "), (None, "SAME word Äöü copyright"), (5, "nowhere"), (6, docs[8][1] + " notice notice")]
    for name, rows, schema in (("benchmark", items, BENCHMARK), ("documents", docs, DOCUMENTS), ("pages", pages, PAGES), ("embeddings", vectors, EMBEDDINGS), ("labels", labels, LABELS)):
        clashing(spark, [] if empty else rows, schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)
