from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postloom.llm import lines
from postloom.llm.lines import LineRuns, without_frequent_lines

UPPER = {c: chr(c + 32) for c in range(65, 91)}


def key(line):
    return line.strip(" \t\n\v\f\r").translate(UPPER)


def brute(texts, min_docs=10, min_chars=1):
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for text in texts:
        every = (text or "").split("\n")
        left = [x for x in every if found[key(x)] < min_docs]
        out.append((len(every), len(every) - len(left), "\n".join(left)))
    return out


def checked(spark, texts, schema="doc_id long, text string", partitions=7, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), schema).repartition(partitions)
    got = without_frequent_lines(docs, **options)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    want = brute(texts, options.get("min_docs", 10), options.get("min_chars", 1))
    assert [tuple(r)[1:] for r in sorted(got.collect())] == want


def texts_of(n, seed=1):
    chance = random.Random(seed)
    pool = [f"Line {i} É{'!' * (i % 4)}" for i in range(60)] + ["", "  ", "\t", "\x85", "\xa0", "x"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    dress = [str, str.upper, lambda x: f"  {x}\t", lambda x: x + "\r"]
    return [
        "\n".join(chance.choice(dress)(x) for x in chance.choices(pool, weights, k=chance.randint(0, 12)))
        for _ in range(n)
    ]


@pytest.mark.parametrize("batches", [1, 2, 6, 11])
def test_like_brute_force(spark, batches):
    checked(spark, texts_of(300) + [None, "", "\n", "\n\n"], batches=batches)


def test_other_limits(spark):
    checked(spark, texts_of(120, seed=2), min_docs=3, min_chars=2)


def test_a_line_counts_once_in_a_document_and_repeated_rows_are_documents(spark):
    checked(spark, ["twice\ntwice\ntwice"] * 4 + ["Twice", "other"] + ["same\nlast"] * 10, min_docs=5)


def test_exactly_at_the_limit(spark):
    checked(spark, ["nine"] * 9 + ["ten"] * 10 + ["TEN\nnine"][:0])


def test_long_texts_and_copies(spark):
    """A third of the rows are one text, and one line is in nearly all."""
    long = "\n".join(f"part {i}" for i in range(40_000)) + "\nshared"
    checked(spark, [long, long.upper()] + ["shared\nown"] * 100 + [f"shared\nline {i}" for i in range(200)])


def test_no_rows_ids_and_clashing_columns(spark):
    assert without_frequent_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([("a", "x\ny")] * 10 + [(None, "x")], "doc_id string, text string")
    docs = docs.selectExpr("*", "1 AS digest", "2 AS key", "3 AS dropped", "4 AS kept", "5 AS n", "6 AS batch")
    got = without_frequent_lines(docs).collect()
    assert sorted((r.doc_id or "", r.n_lines, r.n_dropped, r.kept) for r in got) == [("", 1, 1, "")] + [("a", 2, 2, "")] * 10


def test_runs_are_merged_by_level(spark):
    runs = LineRuns(spark, min_docs=3, fan_in=2)
    want = Counter()
    chance = random.Random(5)
    for batch in range(7):
        counts = Counter(bytes([chance.randrange(40)]) for _ in range(30))
        want += counts
        runs.add(spark.createDataFrame([(bytearray(k), n) for k, n in counts.items()], "key binary, n long"))
        assert [len(level) for level in runs.levels] == [int(b) for b in reversed(bin(batch + 1)[2:])]
    got = {bytes(r.key): r.n for r in runs.frequent().collect()}
    assert got == {k: n for k, n in want.items() if n >= 3}
    runs.close()


def test_merging_runs_moves_no_rows(spark):
    runs = LineRuns(spark, min_docs=2, fan_in=9)
    for low in (0, 50):
        runs.add(spark.range(low, low + 100).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit(1).cast("long").alias("n")))
    plan = runs.frequent()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
    assert runs.frequent().count() == 50
    runs.close()


def test_keys():
    assert lines.line_key(b" \x0b\x1fAb\xc3\x89\x0c\r") == b"\x1fab\xc3\x89"
    assert lines._keys("é\nab".encode(), 2) == {lines._digest(b"ab")}
