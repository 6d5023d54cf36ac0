from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from postloom.llm.privacy import EMAIL, find_private, sanitised
from postloom.llm.secrets import find_secrets
from postloom.llm.spans import matches
from tests.llm import brute

SECRETS = [
    "token: token: abcdef123 " + "a" * 30 + "￿ AKIA" + "B" * 16 + " é𝒳 secret=abcdefgh",
    "PassWord='x' passwd : \"longenough\" api_key=k apikey==abcdef",
    "AKIAAKIA" + "A1" * 9 + " AKIA123 " + "0123456789abcdef" * 3 + "G" + "f" * 23,
    "token=secret=abcdefgh token=ab secret=abcdef12 " + "de" * 400,
    None,
    "",
]
PRIVATE = [
    "a@b.com_x@y.org a@b a@b.c@d.e x..y@z-.q- @no.com é@b.cc",
    "1.2.3.4.5.6.7.8 999.1.1.1 0001.1.1.1 1.2.3 256.1.1.1 255.255.255.255 00000000000000000000001.2.3.4",
    "4111 1111 1111 1111 x 4111-1111-1111-1112 12 4111 1111 1111 1111 4111111111111111 0 4222222222222 12345678901234567890",
    "+1 (555) 123-4567 +12 +1 2 +1-234567890123456 +44 20 7946 0958. ++49 30 123456 +1(",
    "é𝒳 a@b.cc ￿ é +44 20 7946 0958 b@c.dd",
    None,
    "",
]


def noise(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def frame(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "'x' AS mentions", "2 AS row")


def test_base_secrets_like_brute_force(spark):
    texts = SECRETS + noise(list("aeAK0f9 =:\"'_") + ["token", "secret", "api", "key", "AKIA", "passwd"], 300, 1)
    got = find_secrets(frame(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        spans = brute.secret_spans(texts[r.doc_id or 0])
        assert r.base_sha256 == brute.digest(spans, ["assign", "access", "hex"])[0]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(","))


def test_models_tell_random_strings_from_identifiers(spark):
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_string = lambda n: "".join(rng.choice(letters) for _ in range(n))
    parts = "get set user name list item value count index table query join batch writer".split()
    identifier = lambda: "_".join(rng.choice(parts) for _ in range(5))
    samples = [(random_string(30), True) for _ in range(300)] + [(identifier(), False) for _ in range(300)]
    samples += [(None, True), ("", False), ("é", True), ("x", None)]
    s = spark.createDataFrame(samples, "sample string, secret boolean")
    texts = [f"see {random_string(24)} here" for _ in range(100)] + [f"see {identifier()} here" for _ in range(100)]
    texts += ["A" * 20_000, random_string(50_000)]
    got = {r.doc_id: r for r in find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), s).collect()}
    assert sum(got[i].n_random for i in range(100)) >= 98
    assert sum(got[i].n_random for i in range(100, 200)) <= 2
    assert got[0].spans == "random:4:28"
    assert got[201].n_random == 1
    again = find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), s.where("secret"))
    assert again.agg(F.sum("n_random")).first()[0] == 0


def test_base_personal_data_like_brute_force(spark):
    texts = PRIVATE + noise(list("ab.@-+0129 ()_%é"), 400, 3) + noise(list("0123456789 -"), 100, 4) + noise(list("12.25"), 100, 6)
    got = find_private(frame(spark, texts)).collect()
    kinds = ["email", "ip", "card", "phone"]
    assert len(got) == len(texts) + 2
    for r in got:
        spans = brute.private_spans(texts[r.doc_id or 0])
        assert (r.doc_id, r.base_sha256) == (r.doc_id, brute.digest(spans, kinds)[0])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in kinds)
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(","))


def test_revealing_terms_are_taken_out(spark):
    texts = [f"w{i} zz{i}k contact Zorblax please x{i}y at john@corp.example about q{i} thing" for i in range(5)]
    texts += [f"please look at the thing {i}" for i in range(60)]
    texts += ["Quux calls +1 555 123 4567 soon"] * 9  # copies are one context
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = find_private(docs)
    rows = {r.doc_id: r for r in found.join(docs, "doc_id").withColumn("clean", sanitised("text", "found")).collect()}
    for i in range(5):
        words = {texts[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in rows[i].spans.split(",")) if k == "remove"}
        assert {"contact", "Zorblax"} <= words
        assert not words & {f"zz{i}k", "thing", "please"}
        assert "[EMAIL]" in rows[i].clean and "Zorblax" not in rows[i].clean and f"zz{i}k" in rows[i].clean
        assert rows[i].n_terms == len(rows[i].spans.split(",")) - 1
    assert rows[70].spans == "phone:11:26"
    assert rows[70].clean == "Quux calls [PHONE] soon"
    assert rows[30].clean == texts[30]


def test_terms_far_from_a_mention(spark):
    """A name 5,000 characters from the address, cut by no window, and its copies in one long text."""
    filler = lambda i: " ".join(f"v{i}w{j}x" for j in range(700))
    texts = [f"Zorblax wrote {filler(i)} mail john@corp.example and zorblax again" for i in range(4)]
    texts += [f"wrote and mail again {i}" for i in range(80)]
    texts += [texts[0], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in find_private(docs).collect()}
    assert len(rows) == len(texts)
    for i in (0, 1, 2, 3, 84):
        at = texts[i].rindex("zorblax")
        assert {f"remove:{a}:{a + 7}" for a in (0, at)} <= set(rows[i].spans.split(","))
        words = {texts[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in rows[i].spans.split(",")) if k != "email"}
        assert words == {"Zorblax", "zorblax"}
    assert rows[10].spans == rows[85].spans == rows[86].spans == ""


@pytest.mark.parametrize("operator", [find_secrets, find_private])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_matches_and_long_runs(spark):
    text = "a@b.cc " * 3000 + "x" * 200_000 + " 11" * 3000
    docs = spark.createDataFrame([(text,)], "text string")
    got = docs.select(matches(F.col("text"), EMAIL).alias("m")).first().m
    assert [(s.start, s.end) for s in got] == [m.span() for m in re.finditer(r"a@b\.cc", text)]
