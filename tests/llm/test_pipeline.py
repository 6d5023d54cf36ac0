from __future__ import annotations

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.brute import shingle_set
from tests.llm.test_mixing import brute as mixed

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and returned, and the tables."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF_DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    for kept in stages[:-1]:
        assert kept.columns == stages[0].columns


def test_near_duplicates_stage(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    after = {r.doc_id for r in stages[2].collect()}
    sets = {k: shingle_set(t) for k, t in before.items()}
    label = {k: k for k in before}
    similar = [(a, b) for a in before for b in before if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    for _ in before:
        for a, b in similar:
            label[a] = label[b] = min(label[a], label[b])
    assert after == {k for k in before if label[k] == k}


def test_decontamination_stage(stages):
    items = [shingle_set(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF_DIR}/benchmark.parquet'").fetchall()]
    before = stages[2].collect()
    bad = {r.doc_id for r in before if any(len(i & shingle_set(r.text)) / len(i) >= 0.8 for i in items)}
    assert {r.doc_id for r in stages[3].collect()} == {r.doc_id for r in before} - bad


def test_mixing_stage(stages):
    rows = [(r.doc_id, r.text, r.source) for r in stages[3].collect()]
    size, _, _, taken = mixed(rows)
    got = {}
    for r in stages[4].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert {k: n for k, n in got.items()} == {k: t // s for (k, _, _), s, t in zip(rows, size, taken) if t} | {
        k: n for k, n in got.items() if not dict(zip([r[0] for r in rows], size))[k]
    }


def test_tokens_stage(stages):
    tokens = sorted(stages[5].collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in tokens]
    assert ids == sorted(r.doc_id for r in stages[4].collect())
    assert [r.start for r in tokens] == [sum(r.n_tokens for r in tokens[:i]) for i in range(len(tokens))]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    size = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect()}
    assert [r.n_tokens for r in tokens] == [size[r.doc_id] for r in tokens]


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(tuple, stages[5].collect()))


def through(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert through(spark, docs.limit(0), tmp_path).collect() == []


def test_null_repeated_and_clashing(spark, tmp_path):
    """Null ids and texts, repeated rows and columns named like the stages' own."""
    rows = [(1, "one fine day by the sea"), (1, "one fine day by the sea"), (2, None), (3, ""), (None, "a text of no id"), (4, "word " * 30_000)]
    clashing = ("score", "label", "taken", "start", "n_tokens", "part", "ids", "size", "row", "words", "seed")
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "'en' AS lang", "'s' AS source", "1L AS n_chars", *(f"7 AS {c}" for c in clashing)
    )
    got = through(spark, docs, tmp_path).collect()
    assert {r.doc_id for r in got} <= {1, 2, 3, 4, None} and {1, 4} <= {r.doc_id for r in got}
    assert sorted(r.start for r in got)[0] == 0
