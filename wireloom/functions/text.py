"""Label text: token and line correction, and the role of a label, as column expressions.

Only the fuzzy match of a token against the lexicon runs in Python, a batch of distinct tokens at a time.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

# Wire colours, lexicon words and patterns that decide how a label is read.
COLOURS = "BLACK WHITE BLUE GREEN RED ORANGE BROWN GREY GRAY YELLOW VIOLET PURPLE PINK TAN CLEAR SHIELD".split()
WORDS = """
TERMINAL TERMINALS TERMINAL'S CIRCUIT BREAKER AMP POWER SUPPLY SPEED CONTROLLER RECEPTACLE INTERFACE DISCHARGE INFEED
CABLE CABLES SWITCH RELAY GROUND PANEL DISCONNECT PLUG MICRO FEMALE MALE MINI PIN LIGHT MOTOR FUSE CARD CARDS DRIVE
MASTER REVERSE BYPASS RUN START STOP INPUT OUTPUT PHASE SCHEMATIC ASSY DWG REV DATE SIZE SHEET TITLE DRAWN WEIGHT NOTE
NOTES CONNECTED NOT REMOVE INSULATION HEAT SHRINK EXPOSED END MINIMUM CLEARANCE FROM WIRES WIRE KEEP ALL AND THE WITH
EXTERNAL DEVICE CONNECTION SEE DRAWINGS INDIVIDUAL POINTS TERMINATION DOUBLE PLACE LABEL DOOR PROPRIETARY INFORMATION
CONFIDENTIAL PROPERTY SIGNAL TO OF CONTROL BUS COMMON COIL CONTACT NORMALLY OPEN CLOSED
""".split()
LEXICON = COLOURS + WORDS
GAUGES = [8, 10, 12, 14, 16, 18, 20, 22, 24]
DESIGNATOR = r"^(CR|CB|PB|PS|PLG|P|S|L|H|TB|FU|F|M|SW|LT|DISC|SPD|GND|PE)[-_]?[A-Z0-9]{0,6}$"
GAUGE = r"(?i)^(\d{1,2})\s*A[VW]G$"
GARBLED_GAUGE = r"^(.{1,2})A[VWU][GC6]$"
NUMBER = r"^\d{1,4}$"
VOLTAGE = r"(?i)^[+-]?\d{1,3}\s*V(AC|DC)?$"
TERMINAL = r"^([A-Z]{1,2}\d{0,2}|\d{1,2}|[+-])$"
GLYPHS, DIGITS = "ILODGSB", "1100658"
CUTOFF = 0.8
#: White space, as a pattern's \\s has it.
BLANKS = " \t\n\x0b\f\r"
#: Readings that are held against the lexicon at once.
PAIRED = 4096


def trimmed(value: Column) -> Column:
    """Without white space around; null is empty."""
    return F.coalesce(F.trim(value.cast("string"), F.lit(BLANKS)), F.lit(""))


def clean(value: Column) -> Column:
    """Without white space around; null where nothing is left."""
    return F.nullif(trimmed(value), F.lit(""))


def joined(*parts: Column) -> Column:
    """Clean parts joined by one blank; nulls and a stop after a stop go."""
    return F.regexp_replace(F.concat_ws(" ", *parts), r"\.\s*\.(\s|$)", r".$1")


def sentence(*parts: Column) -> Column:
    """The parts that are not blank, joined by one blank; a stop after a stop goes."""
    return joined(*map(clean, parts))


def readings(token: Column) -> Column:
    """The token and its readings under the slashed-zero confusion, in a fixed order."""
    return F.array_distinct(F.array(token, F.replace(token, F.lit("D"), F.lit("O")), F.replace(token, F.lit("0"), F.lit("O")), F.replace(token, F.lit("O"), F.lit("0"))))


def _result(text: Column, confidence: Column | float) -> Column:
    return F.struct(text.alias("text"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"))


def gauge(token: Column) -> Column:
    """(text, confidence) of a clean or garbled AWG gauge, else null; ties go to the smaller size."""
    close = F.replace(token, F.lit(" "), F.lit(""))
    clean = F.regexp_extract(close, GAUGE, 1)
    digits = F.translate(F.regexp_extract(close, GARBLED_GAUGE, 1), GLYPHS, DIGITS)
    value = F.when(digits.rlike(r"^\d+$"), digits.try_cast("int"))
    near = F.get(F.filter(F.array(*map(F.lit, GAUGES)), lambda s: F.abs(s - value) <= 1), F.lit(0))
    legal = value.isin(GAUGES)
    size = F.concat(F.when(legal, value).otherwise(near).cast("string"), F.lit("AWG"))
    sure = F.when(legal & (close == size), 0.95).when(legal, 0.8).otherwise(0.7)
    return F.when(clean != "", _result(F.concat(clean.try_cast("int").cast("string"), F.lit("AWG")), 0.95)).when(size.isNotNull(), _result(size, sure))


def known_token(token: Column, known_designators: list[str] | None = None) -> Column:
    """(text, confidence) by every rule but compound colours and the fuzzy match; null where these are left to decide.

    Lexicon and known designators are tried over all readings before the designator pattern, so results don't depend
    on the order of a hash set.
    """
    words = F.array(*map(F.lit, LEXICON + list(known_designators or [])))
    options = readings(token)
    word = F.get(F.filter(options, lambda r: F.array_contains(words, r)), F.lit(0))
    tag = F.get(F.filter(options, lambda r: r.rlike(DESIGNATOR) & (F.length(r) >= 3)), F.lit(0))
    glyphs = F.concat(F.substring(token, 1, 1), F.translate(F.substring(token, 2, 99), GLYPHS, DIGITS))
    short = F.when(token.rlike(TERMINAL), _result(token, 0.75)).when(glyphs.rlike(TERMINAL), _result(glyphs, 0.6)).otherwise(_result(token, 0.4))
    return (
        F.when(token == "", _result(token, 0.0))
        .when(token.rlike("^[O0]V$"), _result(F.lit("0V"), 0.9))
        .when(token.rlike(NUMBER) | token.rlike(VOLTAGE), _result(token, 0.9))
        .when(gauge(token).isNotNull(), gauge(token))
        .when(word.isNotNull(), _result(word, F.when(word == token, 1.0).otherwise(0.85)))
        .when(tag.isNotNull(), _result(tag, F.when(tag == token, 0.9).otherwise(0.8)))
        .when(F.length(token) <= 3, short)
    )


def _near(readings: list[str]) -> np.ndarray:
    """Which lexicon words (columns) have enough letters in common with a reading (row) for a ratio of CUTOFF, in whatever order.

    This is difflib's quick ratio, of all pairs at once.
    """
    sizes = np.array([len(r) for r in readings], dtype=np.int64)
    letters = np.frombuffer("".join(readings).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    rows = np.repeat(np.arange(len(readings)), sizes)
    common = np.zeros((len(readings), len(LEXICON)), dtype=np.int16)
    for letter in set("".join(LEXICON)):
        held = np.bincount(rows[letters == ord(letter)], minlength=len(readings)).astype(np.int16)
        common += np.minimum.outer(held, np.array([w.count(letter) for w in LEXICON], dtype=np.int16))
    return 2.0 * common / (sizes[:, None] + [len(w) for w in LEXICON]) >= CUTOFF


def _closest(tokens: Iterable[str]) -> dict[str, tuple[str, float]]:
    """The closest lexicon word of each token and the confidence in it: of the first reading that has one."""
    # a ratio of CUTOFF needs lengths within a factor of CUTOFF / (2 - CUTOFF), which is not an exact number
    longest = max(map(len, LEXICON)) * (2 - CUTOFF) / CUTOFF + 1
    pairs = [(t, r) for t in dict.fromkeys(tokens) for r in dict.fromkeys([t, t.replace("D", "O"), t.replace("0", "O"), t.replace("O", "0")]) if len(r) <= longest]
    found = {}
    for start in range(0, len(pairs), PAIRED):
        some = pairs[start : start + PAIRED]
        near = _near([r for _, r in some])
        for at in np.flatnonzero(near.any(axis=1)):
            token, reading = some[at]
            if token not in found and (match := difflib.get_close_matches(reading, [LEXICON[k] for k in np.flatnonzero(near[at])], n=1, cutoff=CUTOFF)):
                found[token] = match[0], round(difflib.SequenceMatcher(None, reading, match[0]).ratio() * 0.9, 2)
    return found


@F.pandas_udf(StructType().add("text", StringType()).add("confidence", DoubleType()))
def fuzzy_token(tokens: pd.Series) -> pd.DataFrame:
    """Null stays null."""
    found = _closest(t for t in tokens if isinstance(t, str))
    return pd.DataFrame([found.get(t, (t, 0.4)) if isinstance(t, str) else (None, None) for t in tokens], columns=["text", "confidence"])


def corrections(tokens: DataFrame, known_designators: list[str] | None = None) -> DataFrame:
    """(token, text, confidence) of the distinct upper-case tokens of tokens (token).

    Compound colours such as WHITE/BLUE are corrected part by part, where every part is a colour.  tokens are read once,
    and nothing is filtered by what a rule says: Spark would try the rule on each row below the distinct instead.
    """
    upper = tokens.select(F.upper(trimmed(F.col("token"))).alias("token")).distinct()
    # the token itself is at 0, the parts of a compound follow
    parts = F.when(F.contains("token", F.lit("/")), F.filter(F.split("token", "/"), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
    pieces = upper.select("token", F.posexplode(F.concat(F.array("token"), parts)).alias("at", "piece")).withColumn("known", known_token(F.col("piece"), known_designators))
    read = pieces.withColumn("fuzzy", fuzzy_token(F.when(F.col("known").isNull(), F.col("piece"))))
    read = read.select("token", "at", F.coalesce("known.text", "fuzzy.text").alias("text"), F.coalesce("known.confidence", "fuzzy.confidence").alias("confidence"))
    whole, part = F.col("at") == 0, F.col("at") > 0
    both = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part, F.struct("at", "text")))), lambda x: x["text"]), "/")
    out = read.groupBy("token").agg(
        F.max(F.when(whole, F.col("text"))).alias("text"), F.max(F.when(whole, F.col("confidence"))).alias("confidence"),
        F.bool_and(F.when(part, F.col("text").isin(COLOURS))).alias("colours"), both.alias("both"), F.min(F.when(part, F.col("confidence"))).alias("least"),
    )
    return out.select("token", F.when(F.col("colours"), F.col("both")).otherwise(F.col("text")).alias("text"), F.when(F.col("colours"), F.col("least")).otherwise(F.col("confidence")).alias("confidence"))


def corrected_lines(lines: DataFrame, known_designators: list[str] | None = None) -> DataFrame:
    """lines (id, raw) with corrected text and mean confidence; lines without a token have '' and 0."""
    tokens = lines.select("id", F.posexplode(F.filter(F.split(trimmed(F.col("raw")), r"\s+"), lambda t: t != "")).alias("at", "token")).withColumn("token", F.upper("token"))
    fixed = tokens.join(corrections(tokens, known_designators), "token").filter("text <> ''")
    joined = fixed.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("text"), F.round(F.avg("confidence"), 2).alias("confidence"))
    return lines.join(joined, "id", "left").select(*lines.columns, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def label_role(text: Column) -> Column:
    """The role a corrected label plays on a wiring diagram."""
    t = F.upper(trimmed(text))
    parts = F.filter(F.split(t, r"\s+"), lambda p: p != "")
    one = F.size(parts) == 1
    colour = F.get(F.split(F.get(parts, F.lit(0)), "/"), F.lit(0)).isin(COLOURS)
    return (
        F.when(t == "", "empty")
        .when(colour & F.exists(parts, lambda p: p.rlike(GAUGE)), "wire_spec")
        .when(colour & one, "wire_colour")
        .when(one & (t.rlike(VOLTAGE) | (t == "0V")), "voltage")
        .when(one & t.rlike(NUMBER), F.when(F.length(t) <= 2, "terminal_number").otherwise("net_number"))
        .when(one & t.rlike(DESIGNATOR), "designator")
        .when(one & t.rlike(r"^[A-Z]{1,2}\d{0,2}$"), "terminal_number")
        .when(F.size(parts) >= 5, "note")
        .otherwise("text")
    )


def wire_spec(text: Column) -> tuple[Column, Column]:
    """Colour and gauge of a wire specification: the first token if it begins with a colour, and the last gauge."""
    parts = F.split(trimmed(text), r"\s+")
    first = F.upper(F.get(parts, F.lit(0)))
    gauges = F.filter(parts, lambda p: p.rlike(GAUGE))
    return F.when(F.get(F.split(first, "/"), F.lit(0)).isin(COLOURS), first), F.upper(F.get(gauges, F.size(gauges) - 1))


def edit_neighbours(tokens: DataFrame, distance: int = 1) -> DataFrame:
    """(token, word) of lexicon words within an edit distance of the tokens; both sides meet on lengths, not on all pairs."""
    spark = tokens.sparkSession
    words = spark.createDataFrame([(w,) for w in LEXICON], "word string").withColumn("size", F.length("word"))
    near = tokens.select("token").distinct().withColumn("size", F.explode(F.sequence(F.length("token") - distance, F.length("token") + distance)))
    return near.join(F.broadcast(words), "size").filter(F.levenshtein("token", "word") <= distance).select("token", "word")

