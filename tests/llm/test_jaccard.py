from __future__ import annotations

import random

import pytest

from postloom.llm.jaccard import (
    _components,
    components,
    keep_one_per_group,
    meetings_needed,
    runs_needed,
    similar_documents,
)
from tests.llm.brute import shingle_set

RNG = random.Random(11)


def words(n):
    return ["".join(RNG.choice("abcdefghijklmnoé") for _ in range(5)) for _ in range(n)]


def changed(text, n):
    text = list(text)
    for _ in range(n):
        text[RNG.randrange(len(text))] = words(1)[0]
    return text


def fixture():
    license_line = words(25)
    docs = []
    for i in range(160):
        text = words(RNG.choice([1, 3, 5, 30, 200]))
        if i % 3 == 0:
            text += license_line
        docs.append(text)
    docs += [changed(RNG.choice(docs[:40]), RNG.choice([0, 1, 2, 4])) for _ in range(80)]
    base = words(300)
    docs += [changed(base, RNG.choice([0, 1, 2, 3])) for _ in range(60)]
    docs += [words(2000)] * 3
    rows = [(i, (" " if i % 4 else " - ").join(t).upper() if i % 5 == 0 else " ".join(t)) for i, t in enumerate(docs)]
    return rows + [(1000, None), (1001, ""), (1002, " ?! "), (1003, " ?! "), (None, rows[9][1]), (None, "only null id here now"), (4, rows[4][1]), (5, rows[200][1])]


def brute(rows):
    """Class (as the set of row numbers), copies, links and linked sets of each row."""
    sets = [frozenset(shingle_set(t)) for _, t in rows]
    n = len(rows)
    linked = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                linked[i][j] = linked[j][i] = True
    label = list(range(n))
    moved = True
    while moved:
        moved = False
        for i in range(n):
            low = min([label[i], *(label[j] for j in range(n) if linked[i][j])])
            moved |= low < label[i]
            label[i] = low
    out = []
    for i in range(n):
        same = [j for j in range(n) if sets[j] == sets[i] and sets[i]] or [i]
        members = [j for j in range(n) if label[j] == label[i]]
        ids = [rows[j][0] for j in members if rows[j][0] is not None]
        own = [rows[j][0] for j in same if rows[j][0] is not None]
        out.append(
            (
                str(rows[i][0]),
                str(min(ids)) if ids else "None",
                str(min(own)) if own else "None",
                len(same),
                sum(linked[i]),
                len({sets[j] for j in range(n) if linked[i][j]} - {sets[i]}),
            )
        )
    return sorted(out), label


@pytest.mark.parametrize(("bucket", "depth"), [(200, 3), (8, 2)])
def test_like_brute_force(spark, bucket, depth):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS run", "2 AS path", "3 AS copies")
    found = similar_documents(docs, bucket=bucket, depth=depth).collect()
    got = sorted((str(r.doc_id), str(r.class_id), str(r.copy_id), r.n_copies, r.n_links, r.n_linked_texts) for r in found)
    assert got == brute(rows)[0]


def test_one_document_of_each_group_stays(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS copy_key", "1 AS c0", "true AS touched")
    kept = keep_one_per_group(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    label = brute(rows)[1]
    of = {}
    for row, group in zip(rows, label):
        of.setdefault(group, []).append(row)
    assert len(left) == len(of)
    for members in of.values():
        stays = [m for m in set(members) if m in left]
        assert len(stays) == 1
        ids = [k for k, _ in members if k is not None]
        assert stays[0][0] == (min(ids) if ids else None)


def test_runs_reach_the_recall():
    assert 1 - (1 - 0.8**3) ** runs_needed(0.8, 3, 0.9999) >= 0.9999
    assert 1 - (1 - 0.8**3) ** (runs_needed(0.8, 3, 0.9999) - 1) < 0.9999


def test_needed_meetings_lose_little():
    rng = random.Random(1)
    m = meetings_needed(0.8, 13, 2e-5)
    assert m == 4
    assert sum(sum(rng.random() < 0.8 for _ in range(13)) < m for _ in range(100_000)) <= 10


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similar_documents(docs).collect() == []
    assert keep_one_per_group(docs).collect() == []


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)]
    RNG.shuffle(path)
    got = {r.node: r.label for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(61), 0) | dict.fromkeys((100, 101, 102), 100)
    import numpy as np

    linked = np.zeros((6, 6), dtype=bool)
    for a, b in ((0, 5), (5, 3), (2, 4)):
        linked[a, b] = linked[b, a] = True
    assert _components(linked).tolist() == [0, 1, 2, 0, 2, 0]
