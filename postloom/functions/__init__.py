"""Column expressions; everything here stays in the JVM."""

from postloom.functions.predicates import has_lang, is_create, is_kind, min_length
from postloom.functions.text import (
    complexity,
    count_matches,
    letter_count,
    readability,
    repeatability,
    sentence_count,
    space_word_count,
    uri_author,
    word_count,
    word_tokens,
)

__all__ = [
    "complexity",
    "count_matches",
    "has_lang",
    "is_create",
    "is_kind",
    "letter_count",
    "min_length",
    "readability",
    "repeatability",
    "sentence_count",
    "space_word_count",
    "uri_author",
    "word_count",
    "word_tokens",
]
