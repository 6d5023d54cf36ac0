from __future__ import annotations

import random

import pytest

from postloom.llm import contamination
from postloom.llm.contamination import contained_items, drop_contaminated
from tests.llm.brute import shingle_set

RNG = random.Random(5)


def words(n):
    return ["".join(RNG.choice("abcdefghijklmnoé") for _ in range(5)) for _ in range(n)]


def fixture():
    items = [(i, " ".join(words(RNG.choice([3, 5, 9, 16, 40, 90])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "!!!"), (None, " ".join(words(30))), (7, " ".join(words(12)))]
    docs = []
    for i in range(150):
        text = words(RNG.choice([0, 4, 60, 4000]))
        for _ in range(RNG.choice([0, 0, 1, 2])):
            item = (RNG.choice(items)[1] or "").split()
            if item and RNG.random() < 0.5:  # a few words changed
                for _ in range(RNG.choice([1, 2])):
                    item[RNG.randrange(len(item))] = "other"
            at = RNG.randint(0, len(text))
            text[at:at] = item
        docs.append((i, ", ".join(text) if i % 2 else " ".join(text).upper()))
    docs += [(900, None), (901, ""), (3, docs[3][1]), (None, items[0][1]), (902, items[0][1]), (903, (" ".join(words(60_000)) + " ") + items[12][1])]
    return docs, items


def brute(docs, items):
    out = []
    for key, text in docs:
        own = shingle_set(text)
        for item, short in items:
            wanted = shingle_set(short)
            if wanted and len(wanted & own) / len(wanted) >= 0.8:
                out.append((str(key), str(item), len(wanted), len(wanted & own), len(wanted & own) / len(wanted)))
    return sorted(out)


@pytest.mark.parametrize("chars", [contamination.BLOCK_CHARS, 2000])
def test_like_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(contamination, "BLOCK_CHARS", chars)
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS n_item")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = sorted((str(r.doc_id), str(r.item_id), r.n_item, r.n_found, r.containment) for r in contained_items(d, b).collect())
    assert got == brute(docs, items)
    assert len(got) > 40
    bad = {key for key, *_ in got}
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns
    left = sorted(str(r.doc_id) for r in kept.collect())
    assert left == sorted(str(k) for k, _ in docs if str(k) not in bad)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert contained_items(docs, one).collect() == []
    assert contained_items(some, items).collect() == []
    assert drop_contaminated(docs, one).collect() == []
    assert drop_contaminated(some, items).count() == 1
    assert contained_items(some, one).count() == 1
