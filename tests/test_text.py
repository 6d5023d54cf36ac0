import re
import unicodedata

import pytest

from postloom.functions import sentence_count, space_word_count, word_count
from postloom.operators import linguistic_features

STOPS = ["the", "a", "is"]
TEXTS = [
    "",
    "word",
    "The a IS the",
    "...!?",
    "One sentence here. And a second one!",
    "cat cat cat",
    "Das ist schön. Été à la mer?\tNon !",
    "a.b.c 3.14 é -- x_y",
    "no end",
    None,
]


def _is_word(c):
    return c == "_" or unicodedata.category(c)[0] in "LMN"


def _tokens(text):
    out, run = [], ""
    for c in text.lower():
        if _is_word(c):
            run += c
            continue
        if run:
            out.append(run)
        run = ""
        if not c.isspace():
            out.append(c)
    return out + ([run] if run else [])


def _sentences(text):
    return sum(any(c.isalnum() or c == "_" for c in s) for s in re.split("[.!?]", text))


def _expected(text):
    tokens = [t for t in _tokens(text) if t not in STOPS]
    repeat = len(tokens) / len(set(tokens)) if tokens else 0.0
    words, sentences = len(text.split()), _sentences(text)
    letters = sum(unicodedata.category(c)[0] == "L" for c in text)
    index = (
        0.0588 * letters / words * 100 - 0.296 * sentences / words * 100 - 15.8 if words else 0.0
    )
    return repeat, (words / sentences if sentences else 0.0), index


def test_statistics_equal_a_plain_rewrite(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for row in linguistic_features(df, "text", STOPS).collect():
        got = (row.repeatability, row.complexity, row.readability)
        if row.text is None:
            assert got == (None, None, None)
        else:
            assert got == pytest.approx(_expected(row.text)), row.text


def test_known_values(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    rows = {r.id: r for r in linguistic_features(df, "text", STOPS).collect()}
    assert rows[5].repeatability == 3.0
    assert rows[2].repeatability == 0.0
    assert rows[4].complexity == 3.5
    assert rows[3].complexity == 0.0
    assert (rows[0].repeatability, rows[0].complexity, rows[0].readability) == (0.0, 0.0, 0.0)


def test_counts(spark):
    df = spark.createDataFrame([("It's 3.5 m. Go on!",)], "text string")
    row = df.select(word_count("text"), space_word_count("text"), sentence_count("text")).first()
    assert tuple(row) == (11, 5, 3)


def test_counting_stays_linear(spark):
    """A long run without a word must not make the patterns back up."""
    long = "-" * 400_000 + " " * 100_000 + "x" * 200_000
    df = spark.createDataFrame([(long,)], "text string")
    row = linguistic_features(df, "text").first()
    assert row.complexity == 2.0


def test_no_udf_and_no_shuffle(spark):
    df = spark.createDataFrame([("x",)], "text string")
    plan = linguistic_features(df, "text", STOPS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("regexp_replace") == 1
