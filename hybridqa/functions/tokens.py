"""Tokens of mixed-script text: Devanagari syllables and stemmed Latin words, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hybridqa.functions.text import SPACE, composed, longest_first

#: Fillers that are cut out anywhere, stopwords, and suffixes in the order in which they are tried.
CUT = ("uh", "um", "ah", "er", "hmm", "mm", "mmm", "thank you", "thanks", "please", "okay", "ok", "yeah", "yes", "no", "हम्म", "म्ह्म", "अरे", "अहो")
STOPWORDS = (
    "आहे", "आहेत", "आहो", "आहात", "होता", "होती", "होते", "होत्या", "होतो", "हा", "ही", "हे", "तो", "ती", "ते", "त्या", "या",
    "आणि", "किंवा", "पण", "परंतु", "तर", "त्यामुळे", "नाही", "नाहीत",
)
SUFFIXES = (
    "lay", "la", "li", "le", "lya", "lyat", "tana", "tani", "tila", "keli", "kela", "kartat", "karayche", "kara", "kar", "kayche",
    "hoti", "hota", "hote", "hotya", "hovo", "have", "hava",
)
STEM_LEAST = 4
#: Fixed value: what parts words.
PUNCTUATION = r"[\s,।;:!?'\"\.\(\)\[\]\{\}<>\/\\|@#\$%\^&\*\-=\+~`_…–—‘’“”।॥]+"
#: A syllable: a chain of consonant and virama that ends in a consonant with its signs, in an independent vowel with
#: its signs, or in any other character of the block; or such a chain at the end of the run.
_C, _V = "[क-ह़]", "्"
_SIGN, _VOWEL_SIGN = "[ा-ॄॆ-ौॎॏ़ऀ-ः]", "[ा-ॄॆ-ौ]"
SYLLABLE = f"(?:{_C}{_V})*+(?:{_C}{_SIGN}*+|[ऄ-औऀ-ः]{_VOWEL_SIGN}*+|[ऀ-ॿ])|(?:{_C}{_V})++"


def stem(w: Column) -> Column:
    """The first suffix of the list that leaves four letters or more goes, from words of six or more."""
    out = F.when(F.length(w) < STEM_LEAST + 2, w)
    for s in SUFFIXES:
        out = out.when(w.endswith(s) & (F.length(w) >= STEM_LEAST + len(s)), F.substring(w, F.lit(1), F.length(w) - len(s)))
    return out.otherwise(w)


def latin_words(c: Column) -> Column:
    """Runs of A-Z, lower-cased, of two letters or more."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), 0), F.lower), lambda w: F.length(w) > 1)


def raw_tokens(c: Column, compose: bool = True) -> Column:
    """Syllables and lower-cased Latin words of two letters or more, before stems and stopwords. compose: False skips the normal form for texts known to be in it."""
    text = F.coalesce(composed(c) if compose else c, F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, f"(?iu){longest_first(CUT)}", " "), PUNCTUATION, " ")
    found = F.regexp_extract_all(text, F.lit(f"[A-Za-z]+|{SYLLABLE}"), 0)
    return F.filter(F.transform(found, lambda t: F.when(t.rlike("^[A-Za-z]"), F.lower(t)).otherwise(t)), lambda t: (F.length(t) > 1) | ~t.rlike("^[a-z]"))


def stemmed(t: Column) -> Column:
    """The token of a raw one: Latin ones are stemmed."""
    return F.when(t.rlike("^[a-z]"), stem(t)).otherwise(t)


def tokens(c: Column, drop_stopwords: bool = False, compose: bool = True) -> Column:
    """All tokens in text order; a null or blank text has none."""
    found = raw_tokens(c, compose)
    if drop_stopwords:
        found = F.filter(found, lambda t: ~t.isin(*STOPWORDS))
    return F.transform(found, stemmed)


def words(c: Column) -> Column:
    """Whole words of both scripts as the vocabulary has them, in their own case."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[ऀ-ॿA-Za-z]+"), 0)


def has_devanagari(c: Column) -> Column:
    return F.coalesce(c.rlike("[ऀ-ॿ]"), F.lit(False))


def has_latin(c: Column) -> Column:
    return F.coalesce(c.rlike("[A-Za-z]"), F.lit(False))


def gate_tokens(c: Column) -> Column:
    """The tokens of the structural gate: between punctuation and white space (a fixed value), lower-cased."""
    return F.filter(F.split(F.lower(c), rf"[{SPACE},।;:!?'\"\.\(\)\[\]\{{\}}<>\/\\|@#$%\^&\*\-=\+~`_…।॥]+"), lambda t: t != "")
