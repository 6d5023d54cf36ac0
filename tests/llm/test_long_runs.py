"""Texts with very long runs: every repeated group has to match without recursion."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from postloom.llm.privacy import CARD, find_private
from postloom.llm.secrets import ORDINARY, ORDINARY_RUNS, find_secrets
from tests.llm.brute import digest, private_spans, secret_spans

LONG = 20_000


@pytest.mark.parametrize("text", ["7" * LONG, "7 " * (LONG // 2) + "7", "1-" * (LONG // 2) + "1", "4111 1111 1111 1111 " * 2000])
def test_private_digits(spark, text):
    """Runs of more than 19 digits are no card and no phone."""
    short = "call +49 30 1234567 or 4111 1111 1111 1111"
    docs = spark.createDataFrame([(1, text), (2, short)], "doc_id long, text string")
    got = {r.doc_id: r.base_sha256 for r in find_private(docs).collect()}
    kinds = ["email", "ip", "card", "phone"]
    assert got == {1: digest([], kinds)[0], 2: digest(private_spans(short), kinds)[0]}


@pytest.mark.parametrize("text", ["a-" * (LONG // 2) + "a", "a" * LONG, "Aa1_" * (LONG // 4), "9" * LONG])
def test_secret_identifiers(spark, text):
    docs = spark.createDataFrame([(1, text), (2, "password = hunter22"), (3, "0123456789abcdef0123456789abcdef")], "doc_id long, text string")
    got = {r.doc_id: r.base_sha256 for r in find_secrets(docs).collect()}
    kinds = ["assign", "access", "hex"]
    assert got == {r.doc_id: digest(secret_spans(r.text), kinds)[0] for r in docs.collect()}


def test_possessive_patterns_match_the_same(spark):
    chance = random.Random(8)
    rows = [("".join(chance.choices("aZ19_/=+- ", weights=[5, 1, 5, 5, 1, 1, 1, 1, 2, 2], k=chance.randint(1, 30))),) for _ in range(3000)]
    plain_card = r"[0-9](?:[\x20-]?[0-9]){11,}"
    got = spark.createDataFrame(rows, "t string").select(
        "t", F.col("t").rlike(ORDINARY_RUNS).alias("ordinary"), F.regexp_extract_all("t", F.lit(CARD), F.lit(0)).alias("cards")
    )
    for r in got.collect():
        assert r.ordinary == bool(re.search(ORDINARY, r.t))
        assert r.cards == re.findall(plain_card, r.t)
