from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postloom.llm import tokens
from postloom.llm.tokens import _Encoder, read_tokens, with_crc32, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Two  spaces, one tab\there", " leading", "trailing ", "a\n b", "\n", "  ", "it's o' 'tis x're", "² Ⅷ ½ x2y a_b",
    "no break space 　 wide", "naïve Ünïcödé. ok", "one <|endoftext|> two<|endoftext|>", "A\n\nB. C\nd e!?\n(f)",
    "x" * 5000, "日本 語 text", "é àb",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return _Encoder(f.read())


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], dtype="<u4").tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_encode_like_the_whole(encoder, tokenizer, text):
    assert ids(encoder, text) == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z9é.,'\"_\n\t-²字 ") + [" "] * 4), max_size=40))
def test_any_text_encodes_like_the_whole(encoder, tokenizer, text):
    assert ids(encoder, text) == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("asldtremv É9.-_\n") + [" ", "'"] * 4), max_size=30), max_size=6))
def test_contractions_and_plain_texts_beside_others(encoder, tokenizer, texts):
    texts = [*texts, "  ", "don't we'll", *TEXTS[:4]]
    found, n = encoder.encode_all(pa.array(texts, pa.string()), np.array([2], dtype="<u4").tobytes())
    wanted = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert n.tolist() == [len(w) for w in wanted]
    assert found.tolist() == sum(wanted, [])


def test_long_texts_and_a_full_cache(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_RUNS", 20)
    with open(PATH, encoding="utf-8") as f:
        small = _Encoder(f.read())
    texts = [" ".join(f"word{i % k} a{i}b," for i in range(20_000)) for k in (3, 7)] + ["z" * 300_000]
    for text in texts * 2:
        assert ids(small, text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        content = f.read()
    whole = Tokenizer.from_str(content)
    for text in TEXTS:
        assert ids(_Encoder(content), text) == whole.encode(text, add_special_tokens=False).ids


def test_file_round_trip(spark, tmp_path, tokenizer):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (40, ""), (45, "same"), (45, "same"), (45, "other"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "key")
    docs = docs.selectExpr("key", "text", "1 AS part", "'x' AS n_tokens", "2 AS start", "3 AS ids")
    path = str(tmp_path / "tokens")
    write_tokens(docs, path, PATH, id_col="key")
    got = read_tokens(spark, path).collect()
    crc = {(r.start, r.n_tokens): r.ids_crc32 for r in with_crc32(read_tokens(spark, path)).collect()}
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *range(len(TEXTS)), 40, 45, 45, 45, 50]
    at = 0
    wanted = {}
    for key, text in rows:
        wanted.setdefault(key, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2])
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert crc[r.start, r.n_tokens] == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        wanted[r.doc_id].remove(list(r.ids))
        at += r.n_tokens
    assert not any(wanted.values())


def test_layout(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('word', id % 7, ' '), 50) AS text").coalesce(1)
    path = tmp_path / "tokens"
    write_tokens(docs, str(path), PATH)
    file = pq.ParquetFile(sorted(path.glob("part-*.parquet"))[0])
    columns = {file.metadata.row_group(0).column(i).path_in_schema: file.metadata.row_group(0).column(i) for i in range(5)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    for name in ("doc_id", "part_start", "n_tokens"):
        assert "DELTA_BINARY_PACKED" in columns[name].encodings
        assert columns[name].has_column_index and columns[name].has_offset_index
    plan = read_tokens(spark, str(path)).select("doc_id", "start")._jdf.queryExecution().toString()
    assert "ids:array" not in plan.split("ReadSchema")[-1]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = str(tmp_path / "tokens")
    write_tokens(docs, path, PATH)
    assert read_tokens(spark, path).collect() == []
    assert with_crc32(read_tokens(spark, path)).collect() == []


def test_checksums_leave_no_encoder_in_their_workers(monkeypatch):
    """A worker that encoded gives its tokenizer back before it reads ids."""

    class Frame:
        schema = ()

        def mapInArrow(self, run, schema):
            return run(iter([pa.RecordBatch.from_pydict({"ids": pa.array([[7]], pa.list_(pa.int32()))})]))

    monkeypatch.setattr(tokens, "_encoders", {1: ("encoder",)})
    first = next(iter(with_crc32(Frame())))
    assert first.column(0).to_pylist() == [zlib.crc32(b"\x07\0\0\0")] and not tokens._encoders
