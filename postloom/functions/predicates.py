"""Record filters. All of them are plain comparisons, so they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.schemas import CREATE, LANGUAGE, MIN_TEXT_LENGTH


def is_create() -> Column:
    return F.col("action") == CREATE


def is_kind(kind: str) -> Column:
    return F.col("type") == kind


def min_length(text: str = "text", n: int = MIN_TEXT_LENGTH) -> Column:
    """At least ``n`` code points."""
    return F.length(text) >= n


def has_lang(langs: str = "langs", lang: str = LANGUAGE) -> Column:
    """True when the tag list holds ``lang``; NULL lists give NULL and drop out."""
    return F.array_contains(F.col(langs), lang)
