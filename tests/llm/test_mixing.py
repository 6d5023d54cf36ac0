from __future__ import annotations

import hashlib
import re

import pytest

from postloom.llm.mixing import mix_sources, repeat_taken


def targets(sizes):
    """Sharing again and again, until no target is above three times its source's size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(capped.values())
        open_weight = sum(w for s, w in weight.items() if s not in capped)
        share = {s: rest * weight[s] / open_weight for s in names if s not in capped}
        above = [s for s in share if share[s] > 3 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in above}


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    per = {}
    for (_, _, s), n in zip(rows, size):
        per[s] = per.get(s, 0) + n
    goal = targets(per)
    rank = {s: i for i, s in enumerate(sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None])}
    key = [hashlib.sha256(f"mix:{'' if k is None else k}".encode()).hexdigest() for k, _, _ in rows]
    places, so_far = [], dict.fromkeys(per, 0)
    for i in sorted(range(len(rows)), key=lambda i: key[i]):
        s = rows[i][2]
        so_far[s] += size[i]
        places += [((c * per[s] + so_far[s]) / goal[s], rank[s], key[i], i) for c in range(3) if goal[s]]
    taken, words, budget = [0] * len(rows), 0, sum(per.values())
    for *_, i in sorted(places):
        words += size[i]
        if words > budget:
            break
        taken[i] += size[i]
    return size, per, goal, taken


ROWS = [(i, "w " * (i * 7919 % 90), f"s{i % 13 if i % 2 else 0}") for i in range(400)]
ROWS += [(500, None, "s1"), (501, "", None), (502, "a b c\td", None), (503, "alone " * 4, "tiny"), (504, "x", "Z")]


def test_like_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS at", "3 AS rows")
    size, per, goal, taken = brute(ROWS)
    got = {r.doc_id: r for r in mix_sources(docs).collect()}
    assert len(got) == len(ROWS)
    for i, (key, _, source) in enumerate(ROWS):
        r = got[key]
        assert (r.size, r.source_size, r.taken) == (size[i], per[source], taken[i])
        assert r.target == pytest.approx(goal[source])
        assert r.taken <= 3 * r.size
    again = {r.doc_id: r for r in mix_sources(docs.repartition(7)).collect()}
    assert got == again


def test_repeated_rows_are_taken_alike(spark):
    rows = [(i % 4, "a b c", "s") for i in range(40)] + [(None, "d e", None)] * 5 + [(i, "f g h i", "t") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    assert len({tuple(r) for r in got if r.source_size == 120}) <= 4
    mixed = repeat_taken(docs, text_col="text").collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in got)


def test_repeat_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 9, "y"), (2, "c", "s", 8, None)], "doc_id long, text string, source string, rows int, at string")
    out = repeat_taken(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}


@pytest.mark.parametrize("rows", [[], [(1, None, "s"), (2, "", None)]])
def test_no_words(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * len(rows)
    assert repeat_taken(docs).columns == docs.columns
