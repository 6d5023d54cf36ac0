from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from postloom.llm.labelled import fit_scale, labelled_sample, sigmoid
from postloom.llm.quality import fit_hinge, indicators, score_quality
from postloom.llm.toxicity import best_threshold, drop_toxic, read_words, score_toxicity

RNG = random.Random(4)


def words(n):
    return ["".join(RNG.choice("abcdefghijklmno") for _ in range(RNG.randint(2, 7))) for _ in range(n)]


def held(key):
    return zlib.crc32(str(key).encode()) % 4 == 2


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = [], []
    for i in range(900):
        text, lang = words(RNG.choice([5, 40, 120])), RNG.choice(["en", "de"])
        toxic, good = int(i % 5 == 0), int(i % 3 != 0)
        if toxic:
            for _ in range(RNG.randint(1, 4)):
                insult = "zorg" + RNG.choice(["a", "el", "ung", "en"]) if lang == "de" else RNG.choice(["vilk", "prat"])
                text.insert(RNG.randint(0, len(text)), insult)
        if not good:
            text = [w + RNG.choice(["$$$", "***"]) for w in text] if i % 2 else [w for w in text for _ in range(6)]
        rows.append((i, " ".join(text), lang))
        if i % 10 != 9:
            labels.append((i, good, toxic))
    rows += [(2000, None, "en"), (2001, "", None), (None, "some text", "xx"), (5, "again five", "en"), (2002, " ".join(words(60_000)), "fr")]
    labels += [(0, None, None), (None, 1, 1), (3, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS label")
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "column", "limit"), [(score_quality, 1, 0.7), (score_toxicity, 2, 0.3)])
def test_held_out_accuracy(tables, score, column, limit):
    rows, labels, docs, marked = tables
    found = score(docs, marked)
    got = found.collect()
    assert len(got) == len(rows)
    plain = lambda rs: sorted((str(r.doc_id), round(r.score, 4)) for r in rs)
    assert plain(got) == plain(score(docs.repartition(5), marked).collect())
    truth = {x[0]: x[column] for x in labels[:-3]}
    right = total = 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and held(r.doc_id))
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= limit)
        if r.held_out and r.doc_id in truth and r.doc_id != 5:
            total += 1
            right += r.predicted == truth[r.doc_id]
    assert total > 100
    assert right / total >= 0.93


def test_toxic_rows_go(tables):
    rows, labels, docs, marked = tables
    kept = drop_toxic(docs, marked)
    assert kept.columns == docs.columns
    flagged = {str(r.doc_id) for r in score_toxicity(docs, marked).where("flagged").collect()}
    left = {str(r.doc_id) for r in kept.collect()}
    assert {"2000", "2001"} <= left
    assert left >= {str(k) for k, *_ in rows} - flagged
    assert not left & (flagged - {"2000", "2001", "5"})


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_without_labels_or_rows(spark, tables, score):
    _, _, docs, marked = tables
    assert {r.score for r in score(docs, marked.limit(0)).collect()} == {0.5}
    assert score(docs.limit(0), marked).collect() == []
    assert {r.score for r in score(docs, marked.where("quality = 1 AND toxic = 0")).collect()} == {0.5}


def test_sample_is_bounded_and_never_held_out(tables):
    _, _, docs, marked = tables
    sample, sizes = labelled_sample(docs, marked, "toxic", per_class=50)
    got = sample.collect()
    assert not any(held(r.doc_id) for r in got)
    assert len({r.doc_id for r in got}) == len(got)
    assert 20 < sum(r.label for r in got) < 90 and 20 < sum(1 - r.label for r in got) < 90
    assert sizes[1] < sizes[0]


def test_indicators_are_distinct_n_grams():
    assert len(indicators(None)) == len(indicators(" \n")) == 0
    assert len(indicators("a b")) == len(set(indicators("a b"))) == 2 + 1 + 1 + 1
    assert set(indicators("Word word")) != set(indicators("word Word"))


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(50, 8, replace=False)) for _ in range(200)]
    labels = np.array([int(3 in r) for r in rows])
    weights = fit_hinge(rows, [np.ones(8) for _ in rows], labels, passes=100)
    margins = np.array([weights[r].sum() + weights[-1] for r in rows])
    assert ((margins > 0) == (labels == 1)).all()


def test_scale_follows_the_class_shares():
    rng = np.random.default_rng(1)
    labels = (rng.random(4000) < 0.2).astype(int)
    margins = rng.normal(labels * 2.0, 1.0)
    slope, offset = fit_scale(margins, labels, np.full(4000, 1 / 4000))
    assert abs(sigmoid(slope * margins + offset).mean() - 0.2) < 0.02
    assert best_threshold(np.array([0.9, 0.8, 0.2]), np.array([1, 1, 0]), np.ones(3)) == pytest.approx(0.5)


def test_words_are_laid_out_with_pads():
    features, layout, begins = read_words([b"one two one", b"", b"two"])
    pad = len(features)
    assert pad == 2
    assert begins.tolist() == [0, 6, 9, 13]
    assert (layout[[3, 4, 5, 6, 7, 8, 10, 11, 12]] == pad).all()
    assert layout[0] == layout[2] != layout[1] == layout[9]
