"""Text statistics as Column expressions.

Rules used here (patterns avoid look-around and backtracking, so each is one
linear pass over the text whatever it holds):

* word token: maximal run of letters, marks, digits and underscores;
* word count: word tokens plus every single non-space mark;
* sentence: stretch between ``. ! ?`` that holds a letter, digit or underscore;
* whitespace word: maximal run of non-space characters.

NULL text gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.schemas import STOP_WORDS, URI_AUTHOR_PATTERN

SPACE = r"\s\x0B\p{Z}"
WORD_OR_MARK = rf"[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_{SPACE}]"
NON_SPACE_RUN = rf"[^{SPACE}]+"
SENTENCE = r"[\p{L}\p{N}_][^.!?]*"
NON_LETTERS = r"\P{L}+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uri_author(uri: Column | str) -> Column:
    """Author id inside a record URI, ``''`` when there is none."""
    return F.regexp_extract(_col(uri), URI_AUTHOR_PATTERN, 1)


def count_matches(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(_col(text), F.lit(pattern))


def word_tokens(text: Column | str) -> Column:
    """Lower-cased word tokens and single marks, in order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD_OR_MARK), F.lit(0))


def word_count(text: Column | str) -> Column:
    return count_matches(text, WORD_OR_MARK)


def space_word_count(text: Column | str) -> Column:
    return count_matches(text, NON_SPACE_RUN)


def sentence_count(text: Column | str) -> Column:
    return count_matches(text, SENTENCE)


def letter_count(text: Column | str) -> Column:
    return F.length(F.regexp_replace(_col(text), NON_LETTERS, ""))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _ratio_or_zero(pair: Column) -> Column:
    """n / d; 0.0 when d is 0, NULL when d is NULL."""
    return F.when(pair["d"] == 0, F.lit(0.0)).when(pair["d"] > 0, pair["n"] / pair["d"])


def repeatability(text: Column | str, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Tokens that are no stop words, divided by the distinct ones among them."""
    tokens = word_tokens(text)
    if stop_words:
        stops = [w.lower() for w in stop_words]
        tokens = F.filter(tokens, lambda t: ~t.isin(stops))
    sizes = _bind(
        tokens,
        lambda ts: F.struct(
            F.array_size(ts).alias("n"), F.array_size(F.array_distinct(ts)).alias("d")
        ),
    )
    return _bind(sizes, _ratio_or_zero)


def complexity(text: Column | str) -> Column:
    """Whitespace words per sentence."""
    pair = F.struct(space_word_count(text).alias("n"), sentence_count(text).alias("d"))
    return _bind(pair, _ratio_or_zero)


def _coleman_liau(counts: Column) -> Column:
    # fixed values: coefficients of the published index, per 100 words
    letters = F.lit(100.0) * counts["letters"] / counts["words"]
    sentences = F.lit(100.0) * counts["sentences"] / counts["words"]
    index = F.lit(0.0588) * letters - F.lit(0.296) * sentences - F.lit(15.8)
    return F.when(counts["words"] == 0, F.lit(0.0)).when(counts["words"] > 0, index)


def readability(text: Column | str) -> Column:
    """Coleman-Liau index from its published formula; 0.0 without any word."""
    counts = F.struct(
        letter_count(text).alias("letters"),
        space_word_count(text).alias("words"),
        sentence_count(text).alias("sentences"),
    )
    return _bind(counts, _coleman_liau)
