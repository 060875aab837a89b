"""Normalisation of noisy utterances as Column expressions, in the order in which it is applied."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hybridqa.cluster import materialise

#: The noise words of brackets, the phrases that speech recognition invents, and the fillers.
NOISE = ("noise", "silence", "inaudible", "crosstalk", "music", "applause", "laughter", "background", "static", "beep")
PHRASES = (
    "thank you for watching", "thanks for watching", "please subscribe", "subscribe for more", "like and subscribe",
    "don't forget to subscribe", "thanks for watching, please subscribe", "thank you for watching, please subscribe",
    "music", "applause", "laughter", "[music]", "[applause]", "[laughter]", "(music)", "(applause)", "(laughter)",
    "[background music]", "[__noise__]", "[noise]", "[silence]", "[inaudible]", "[crosstalk]", "aaj tak", "you", "so,",
)
FILLERS = ("uh", "um", "ah", "er", "hmm", "mm", "mmm", "uhh", "umm", "yeah", "yep", "nope")
FILLERS_MR = ("हम्म", "म्हम", "म्म", "अरेराव", "अहो")
#: What Python's str calls white space and word characters, as explicit classes: Java's own differ on Devanagari signs.
SPACE = r"\p{Z}\t-\r\x1c-\x1f\x85"
WORD = r"\p{L}\p{N}_"


def escaped(s: str) -> str:
    """A literal inside a regular expression that Java and RE2 both read."""
    return "".join(c if c.isalnum() or c in " '_,-" or ord(c) > 127 else f"\\{c}" for c in s)


def longest_first(literals: tuple[str, ...]) -> str:
    """An alternation of literals in which a longer one is tried before those it contains."""
    return "|".join(escaped(x) for x in sorted(literals, key=len, reverse=True))


#: Bracketed noise, and any bracketed text.
BRACKET_NOISE = rf"[(\[][{SPACE}{WORD}]*?(?:{'|'.join(NOISE)})[{SPACE}{WORD}]*?[)\]]"
BRACKETS = r"\[[^\]]*\]|\([^)]*\)"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C, for which Spark has no function; in Arrow batches. Only for texts that aren't ASCII."""
    return s.str.normalize("NFC")


def composed(c: Column) -> Column:
    """The normal form; ASCII is in it already and never leaves the JVM's buffers but as a null."""
    ascii_only = c.rlike(r"^\p{ASCII}*$")
    return F.when(ascii_only, c).otherwise(nfc(F.when(~ascii_only, c)))


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder: later plans start from it."""
    return materialise(df, "cut")


def strip(c: Column) -> Column:
    """Without white space of any script at both ends (trim() knows U+0020 only)."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def guard(c: Column) -> Column:
    """null_input, empty_input or null."""
    return F.when(c.isNull(), "null_input").when(strip(c) == "", "empty_input")


def strip_brackets(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"(?iu){BRACKET_NOISE}", " "), BRACKETS, " ")


def strip_phrases(c: Column) -> Column:
    """Without word boundaries: `you` goes out of `your` too. Only texts with a part of a phrase go through the long pattern."""
    low = F.lower(c)
    hint = c.contains("ſ")
    for part in ("thank", "subscribe", "music", "applause", "laughter", "noise", "silence", "inaudible", "crosstalk", "aaj tak", "you", "so,"):
        hint = hint | low.contains(part)
    return F.when(hint, F.regexp_replace(c, f"(?iu){longest_first(PHRASES)}", " ")).otherwise(c)


def normalise_devanagari(c: Column) -> Column:
    c = F.translate(F.translate(c, "‌‍﻿", ""), "़", "")
    return F.replace(F.replace(c, F.lit("।।"), F.lit("।")), F.lit("॥"), F.lit("।"))


def drop_fillers(c: Column) -> Column:
    """Tokens between single spaces that are fillers once lower-cased and freed of punctuation; empty tokens go too."""
    bare = lambda w: F.regexp_replace(F.lower(w), "^[।?,.!\"']+|[।?,.!\"']+$", "")
    return F.array_join(F.filter(F.split(c, " "), lambda w: (w != "") & ~bare(w).isin(*FILLERS, *FILLERS_MR)), " ")


def collapse_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{SPACE}]+", " "))


def collapse_marks(c: Column) -> Column:
    """Runs of one punctuation mark (the pattern is a fixed value)."""
    return F.regexp_replace(c, r"([।?!,.\-])\1+", "$1")


def collapse(c: Column) -> Column:
    """Runs of five or more of a character (a fixed value), runs of a punctuation mark, and white space."""
    return collapse_space(collapse_marks(F.regexp_replace(c, r"(?d)(.)\1{4,}", "$1")))


def garbage(c: Column) -> Column:
    """Why a cleaned text is garbage, or the empty string."""
    return F.when(c == "", "empty_after_cleanup").when(F.length(strip(c)) < 2, "too_short_after_cleanup").when(~c.rlike(r"\p{L}"), "no_alpha_chars").otherwise("")


def normalise(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds n: STRUCT<raw, cleaned, is_garbage, reason, transformations> of a raw utterance (null and blank: garbage).

    Each step is a projection of its own, so that its regular expression runs once though two columns need it.
    """
    names = ["__0", "__1", "__2", "__3", "__4", "__5"]
    out = df.withColumn("__0", composed(strip(F.coalesce(raw, F.lit("")))))
    steps = (strip_brackets, strip_phrases, normalise_devanagari, drop_fillers, collapse)
    for a, b, step in zip(names[:-1], names[1:], steps, strict=True):
        out = out.withColumn(b, step(F.col(a)))
    labels = ("strip_bracket_noise", "strip_hallucination", "normalize_devanagari", "drop_fillers")
    log = [F.lit("nfc"), *(F.when(F.col(a) != F.col(b), label) for a, b, label in zip(names[:4], names[1:5], labels, strict=True)), F.lit("collapse_noise")]
    early = guard(F.col(raw))
    reason = F.coalesce(early, garbage(F.col("__5")))
    n = F.struct(
        F.coalesce(raw, F.lit("")).alias("raw"), F.when(early.isNotNull(), "").otherwise(F.col("__5")).alias("cleaned"),
        (reason != "").alias("is_garbage"), reason.alias("reason"),
        F.when(early.isNotNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*log))).alias("transformations"),
    )
    return out.withColumn("n", n).drop(*names)
