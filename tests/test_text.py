"""Normaliser, tokens, intent and parsers on the published fixtures of the job."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hybridqa.cluster import ship
from hybridqa.functions import intent as I
from hybridqa.functions import text as T
from hybridqa.functions import tokens as K
from hybridqa.functions.translit import forms, to_devanagari, to_roman


@pytest.fixture(scope="module", autouse=True)
def _ship(spark):
    ship(spark)


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.select("i", expression(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


CLEANED = [
    ("प्रवेश कशी घ्यायची", "प्रवेश कशी घ्यायची", ""), ("Thank you for watching. प्रवेश कशी घ्यायची", ". प्रवेश कशी घ्यायची", ""),
    ("[noise] fees किती आहे [music]", "fees किती आहे", ""), ("uh, um, हम्म, मला वाटतं", "मला वाटतं", ""), ("राज़ा आणि राणी", "राजा आणि राणी", ""),
    ("aaaaaa शिवाजी.........", "a शिवाजी.", ""), ("aaa शिवाजी", "aaa शिवाजी", ""), ("Thank you for watching. Please subscribe.", ". .", "no_alpha_chars"),
    ("?, ।।  ...", "?, । .", "no_alpha_chars"), ("", "", "empty_input"), ("   ", "", "empty_input"), (None, "", "null_input"), ("your fees", "r fees", ""),
    ("fees (2024) kiti", "fees kiti", ""), ("100000 fees", "10 fees", ""),
]


def test_normalise(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(CLEANED)], "i int, raw string")
    got = T.normalise(rows).orderBy("i").select("n.*").collect()
    assert [(r["cleaned"], r["reason"]) for r in got] == [(c, why) for _, c, why in CLEANED]
    assert [r["is_garbage"] for r in got] == [bool(why) for _, _, why in CLEANED]
    assert got[0]["transformations"] == ["nfc", "collapse_noise"] and got[2]["transformations"] == ["nfc", "strip_bracket_noise", "drop_fillers", "collapse_noise"]


TOKENS = [
    ("प्रवेश", ["प्र", "वे", "श"]), ("admission kashi", ["admission", "kashi"]), ("fees किती आहे", ["fees", "कि", "ती", "आ", "हे"]), ("uh हम्म hello", ["hello"]),
    ("", []), (None, []), ("teacher", ["teach"]), ("aahe", []), ("sthapla", ["sthap"]), ("अॅडमिशन", ["अ", "ॅ", "ड", "मि", "श", "न"]),
]


def test_tokens(spark):
    assert column(spark, [t for t, _ in TOKENS], K.tokens) == [x for _, x in TOKENS]
    assert column(spark, ["हे घर"], lambda c: K.tokens(c, drop_stopwords=True)) == [["घ", "र"]]


INTENTS = [
    ("Swarajya ka sthapla?", "WHY"), ("Delhi madhye Shivaji Maharaj janmale ka?", "YES_NO"), ("प्रवेश कशी घ्यायची", "HOW"), ("फी किती आहे", "HOW_MUCH"), ("परीक्षा कधी आहे", "WHEN"),
    ("पुस्तके कुठे मिळतात", "WHERE"), ("admission प्रक्रिया काय आहे", "WHAT"), ("fees aahe kadhi", "YES_NO"), ("शिवाजी महाराज कोणत्या काळात झाले", "UNKNOWN"), ("", "UNKNOWN"), (None, "UNKNOWN"),
]


def test_intent(spark):
    assert column(spark, [t for t, _ in INTENTS], I.intent) == [x for _, x in INTENTS]


def test_answer_parsers(spark):
    assert column(spark, ["हेतू: WHY\nसंदर्भ: 2", "intent: whoever", "intent: SHOW", "x", None], I.intent_of_answer) == ["WHY", "WHO", "HOW", "UNKNOWN", "UNKNOWN"]
    assert column(spark, ["संदर्भ: 2", "संदर्भ: 12", "pick 3 please", "context: 0", "none", None], I.context_of_answer) == [2, 1, 3, 0, 0, 0]


def walk(text):
    """The syllable walker that the expression stands for, letter by letter."""
    consonant = lambda c: "क" <= c <= "ह" or c == "़"
    out, i = [], 0
    while i < len(text):
        start = i
        while i < len(text):
            c = text[i]
            i += 1
            if consonant(c):
                if i < len(text) and text[i] == "्":
                    i += 1
                    continue
                while i < len(text) and (text[i] in "ािीुूृॄॆेैॉॊोौॎॏ़ऀँंः"):
                    i += 1
            elif "ऄ" <= c <= "औ" or c in "ऀँंः":
                while i < len(text) and text[i] in "ािीुूृॄॆेैॉॊोौ":
                    i += 1
            break
        out.append(text[start:i])
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("कखहऱऴ्ािॄॅेौंँःअआऔॐ०९।ऄ"), max_size=12))
def test_syllables_follow_the_walker(text):
    java = K.SYLLABLE  # the same syntax is Python's from 3.11 on
    assert re.findall(java, text) == walk(text)


def test_transliteration(spark):
    assert to_roman("प्रवेश किती") == "praveza kitI" and to_devanagari("praveza") == "प्रवेश"
    assert to_devanagari("kam") == "कम्" and to_devanagari("k-a") == "क्-अ"
    assert column(spark, ["प्रवेश", "kam", "123"], forms) == [["प्रवेश", "praveza"], ["kam", "कम्"], ["123"]]


def test_space_is_unicode(spark):
    assert column(spark, ["  x　", "\x1cx "], T.strip) == ["x", "x"]
