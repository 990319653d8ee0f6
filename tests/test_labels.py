"""Corrections of label tokens against a plain walk of the rules, and what they read."""

from __future__ import annotations

import difflib
import random
import re

from wireloom.functions import text as X

FIXES = str.maketrans(X.GLYPHS, X.DIGITS)
GARBLED = "BLUE 1GAWG|IOAVG|99AWG|18 awg|OV|0V|110|24VDC|WHITE/RED|WHlTE/BLUE|WHITE/CR5|BLUE/BLUF/GREEN|/|//|RED/|CR-12|C8|A1|AI|?|P0WER|BREAKR|TERMINL|PR0PRIETARY|ORDNGE|ÜBER|ẞ|large ring|  |WHITE/RED 33AWG|COIL|COIIL|DOO0R|TERMINAL'S|XXKEEP|TERMINALABCD|INEED/CONFIDENTIAL".split("|")


def spec(token: str) -> tuple[str, float] | None:
    if m := re.match(X.GAUGE, token.replace(" ", "")):
        return f"{int(m[1])}AWG", 0.95
    if (m := re.match(X.GARBLED_GAUGE, token.replace(" ", ""))) and (digits := m[1].translate(FIXES)).isdigit():
        value = int(digits)
        if value in X.GAUGES:
            return f"{value}AWG", 0.95 if token == f"{value}AWG" else 0.8
        return next(((f"{g}AWG", 0.7) for g in X.GAUGES if abs(g - value) <= 1), None)
    return None


def corrected(token: str, compound: bool = True) -> tuple[str, float]:
    """One token by the rules, the lexicon over all readings first."""
    parts = [corrected(p, False) for p in token.split("/") if p] if compound and "/" in token else []
    if parts and all(p[0] in X.COLOURS for p in parts):
        return "/".join(p[0] for p in parts), min(p[1] for p in parts)
    if token == "" or re.match("^[O0]V$", token):
        return ("", 0.0) if token == "" else ("0V", 0.9)
    if re.match(X.NUMBER, token) or re.match(X.VOLTAGE, token):
        return token, 0.9
    if made := spec(token):
        return made
    readings = list(dict.fromkeys([token, token.replace("D", "O"), token.replace("0", "O"), token.replace("O", "0")]))
    for r in readings:
        if r in X.LEXICON:
            return r, 1.0 if r == token else 0.85
    for r in readings:
        if re.match(X.DESIGNATOR, r) and len(r) >= 3:
            return r, 0.9 if r == token else 0.8
    if len(token) <= 3:
        glyphs = token[0] + token[1:].translate(FIXES)
        return (token, 0.75) if re.match(X.TERMINAL, token) else (glyphs, 0.6) if re.match(X.TERMINAL, glyphs) else (token, 0.4)
    for r in readings:
        if match := difflib.get_close_matches(r, X.LEXICON, n=1, cutoff=X.CUTOFF):
            return match[0], round(difflib.SequenceMatcher(None, r, match[0]).ratio() * 0.9, 2)
    return token, 0.4


def garbled(seed: int, n: int) -> list[str]:
    """Words of the lexicon with a letter or two replaced, dropped, doubled or swapped, some of them joined by a stroke."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        word = list(rng.choice(X.LEXICON))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(word))
            word[at : at + 1] = rng.choice([[], [word[at]] * 2, [rng.choice("ABDEO0I1ÄX ")], [rng.choice("ABDEO0I1ÄX "), word[at]]])
            word = word or ["O"]
        out.append("".join(word))
    return out + ["/".join(rng.sample(X.COLOURS, 2)) for _ in range(20)] + ["/".join(rng.sample(out, 2)) for _ in range(50)]


def test_corrections_equal_a_plain_walk(spark):
    tokens = [*GARBLED, *garbled(14, 600), None]
    got = X.corrections(spark.createDataFrame([(t,) for t in tokens], "token string").repartition(4))
    want = {t: corrected(t) for t in {(t or "").strip().upper() for t in tokens}}
    rows = got.collect()
    assert len(rows) == len(want) and {r.token: (r.text, r.confidence) for r in rows} == want


def test_corrections_read_their_tokens_once(spark):
    """A filter by what a rule says would be tried on every row, and each branch would read the tokens again."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(t,) for t in GARBLED * 20], "token string")
    out = X.corrections(rows.mapInArrow(counted, "token string"))
    assert out.count() == len({t.strip().upper() for t in GARBLED})
    assert read.value == len(GARBLED) * 20


def test_rules_are_tried_on_distinct_tokens(spark, tmp_path):
    spark.createDataFrame([(t,) for t in GARBLED], "token string").write.parquet(str(tmp_path / "t"))
    plan = X.corrections(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1  # so what follows the last aggregate in the text is all that is below it
    assert "RLIKE" in plan and "RLIKE" not in plan.rsplit("Aggregate", 1)[1]


def test_words_near_enough_are_those_of_the_quick_ratio():
    readings = [*garbled(3, 300), "", "Ω" * 5, "TERMINAL" * 40]
    near = X._near(readings)
    for at, r in enumerate(readings):
        assert [w for w, n in zip(X.LEXICON, near[at], strict=True) if n] == [w for w in X.LEXICON if difflib.SequenceMatcher(None, w, r).quick_ratio() >= X.CUTOFF]


def test_close_words_equal_difflib():
    tokens = garbled(5, 5000)  # more readings than are taken at once
    found = X._closest(tokens)
    for t in tokens:
        want = None
        for r in dict.fromkeys([t, t.replace("D", "O"), t.replace("0", "O"), t.replace("O", "0")]):
            if match := difflib.get_close_matches(r, X.LEXICON, n=1, cutoff=X.CUTOFF):
                want = match[0], round(difflib.SequenceMatcher(None, r, match[0]).ratio() * 0.9, 2)
                break
        assert found.get(t) == want
    assert X._closest([]) == {}


def test_a_ratio_of_exactly_the_cutoff_is_a_match(spark):
    """6 and 12 letters are 1.5 times 4 and 8, which a factor made of floats left out."""
    rows = X.corrections(spark.createDataFrame([("XXKEEP",), ("TERMINALABCD",)], "token string")).collect()
    assert {r.token: (r.text, r.confidence) for r in rows} == {"XXKEEP": ("KEEP", 0.72), "TERMINALABCD": ("TERMINAL", 0.72)}
