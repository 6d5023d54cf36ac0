"""Text statistics added to a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from postloom.functions import complexity, readability, repeatability
from postloom.schemas import STOP_WORDS


def linguistic_features(
    df: DataFrame, text_col: str = "text", stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """Add ``repeatability``, ``complexity`` and ``readability``."""
    return df.withColumns(
        {
            "repeatability": repeatability(text_col, stop_words),
            "complexity": complexity(text_col),
            "readability": readability(text_col),
        }
    )
