"""Token ids as Parquet: list columns, small row groups, page indexes."""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.common import release_memory

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10

#: Encoded runs that a worker keeps besides those in hand, about 50 MB.
CACHED_RUNS = 200_000
#: Bytes of text that are encoded together.
CHUNK_BYTES = 4 << 20
#: New runs that go through the model as one text.
JOINED_RUNS = 1000

_SCHEMA = "doc_id {id}, part int, part_start bigint, n_tokens bigint, ids array<int>"
# Texts of Latin letters, digits, ASCII marks, and single spaces and line breaks.
_char = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f0-9!-/:-@\\[-`{-~]"
_plain = rf"\A ?{_char}(?:[\n ]?{_char})*\z"
# What a byte of such a text is: every other byte is part of a letter.
_LETTER, _DIGIT, _MARK, _SPACE, _LINE = range(5)
_kinds = np.zeros(256, dtype=np.uint8)
_kinds[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _MARK
_kinds[0x30:0x3A] = _DIGIT
_kinds[0x20], _kinds[0x0A] = _SPACE, _LINE
# The contractions that byte-level rules keep whole.
_contractions = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")
_encoders: dict[int, tuple] = {}


def _as_bytes(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _runs(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the runs of plain texts begin that byte-level rules keep apart; ``texts`` has the starts of texts.

    A run is letters, digits or marks with the space before them, a line break, or a contraction.
    """
    kind = _kinds[data]
    begins = np.empty(len(data), dtype=bool)
    begins[:1] = True
    begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
    begins[texts] = True
    quotes = np.flatnonzero(begins & (data == ord("'")))
    for word in _contractions if len(quotes) else ():
        here = quotes[quotes + len(word) <= len(data)]
        for j, byte in enumerate(word[1:], 1):
            here = here[(data[here + j] == byte) & ~np.isin(here + j, texts)]
        begins[here + 1] = False
        after = here + len(word)
        begins[after[after < len(data)]] = True
    return np.flatnonzero(begins)


def _uncached(model: dict):
    """The tokenizer's model without a cache of words."""
    from tokenizers import models

    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    rules = {k: model[k] for k in ("dropout", "unk_token", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)}
    return models.BPE(model["vocab"], merges, cache_capacity=0, **rules)


class _Encoder:
    """Encodes texts with a tokenizer from the tokenizers library, each distinct run once.

    A byte-level tokenizer cuts a plain text into runs (``_runs``) and merges inside them
    only, so the text's ids are those of its runs. Any other text, or tokenizer, goes whole
    through the library.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        setting = json.loads(tokenizer_json)
        rules = setting.get("pre_tokenizer") or {}
        self.by_run = (
            setting["model"].get("type", "BPE") == "BPE"
            and not setting.get("normalizer")
            and rules.get("type") == "ByteLevel"
            and rules.get("use_regex", True)
            and not rules.get("add_prefix_space")
            and not setting["model"].get("continuing_subword_prefix")
            and not setting["model"].get("end_of_word_suffix")
        )
        self.special = "|".join(re.escape(x["content"]) for x in setting.get("added_tokens", []))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in (10, *range(32, 0x250))}
        # runs with a space before them as words of one text; the model's own cache would not hold them
        self.parted = {**self.as_bytes, 32: " " + self.as_bytes[32]}
        self.by_space = Tokenizer(_uncached(setting["model"]) if self.by_run else self.tokenizer.model)
        self.by_space.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(self.as_bytes[32])]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _learn(self, runs: list[str]) -> None:
        """Ids of runs from the model."""
        spaced = sorted((r for r in runs if r[0] == " "), key=str.isascii)
        joined = ["".join(spaced[i : i + JOINED_RUNS]) for i in range(0, len(spaced), JOINED_RUNS)]
        joined = [j.replace(" ", self.parted[32]) if j.isascii() else j.translate(self.parted) for j in joined]
        encoded = self.by_space.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.array([i for e in encoded for i in e.ids], dtype="<u4")
        # only the first token of such a run begins with a space
        begins = np.flatnonzero(self.begins[ids])
        if len(begins) == len(spaced):
            data, cuts = ids.tobytes(), (4 * np.append(begins, len(ids))).tolist()
            self.known.update((r, data[i:j]) for r, i, j in zip(spaced, cuts[:-1], cuts[1:]))
        for run in runs:
            if run not in self.known:
                self.known[run] = _as_bytes([t.id for t in self.tokenizer.model.tokenize(run.translate(self.as_bytes))])

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [_as_bytes(e.ids) for e in encoded]

    def _of_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of distinct runs. Those not met while half a cache of others was learnt are forgotten."""
        if len(self.known) > CACHED_RUNS // 2:
            self.before, self.known = self.known, {}
        found = list(map(self.known.get, runs))
        if None not in found:
            return found
        missing = [r for r, ids in zip(runs, found) if ids is None]
        held = list(map(self.before.get, missing))
        self.known.update((r, ids) for r, ids in zip(missing, held) if ids is not None)
        self._learn([r for r, ids in zip(missing, held) if ids is None])
        return list(map(self.known.__getitem__, runs))

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, each text's followed by ``end``, and how many each has."""
        texts = texts.fill_null("")
        by_run = np.zeros(len(texts), dtype=bool)
        if self.by_run:
            by_run = pc.match_substring_regex(texts, _plain).to_numpy(zero_copy_only=False)
            if self.special:
                by_run = by_run & ~pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        whole = self._ids(texts.filter(pa.array(~by_run)).to_pylist())
        plain = pa.concat_arrays([texts.filter(pa.array(by_run))]).cast(pa.large_string())
        to = np.frombuffer(plain.buffers()[1], dtype=np.int64)[plain.offset :][: len(plain) + 1] if len(plain) else np.zeros(1, np.int64)
        data = np.frombuffer(plain.buffers()[2], dtype=np.uint8)[to[0] : to[-1]] if len(plain) else np.zeros(0, np.uint8)
        begins = _runs(data, to[:-1] - to[0])
        n = np.ones(len(texts), dtype=np.int64)
        n[by_run] = np.diff(np.searchsorted(begins, to - to[0]))
        offsets = pa.py_buffer(np.append(begins, len(data)))
        coded = pa.LargeStringArray.from_buffers(len(begins), offsets, pa.py_buffer(data)).dictionary_encode()
        # arrays by run and by id are as long as the text: none is kept, and numbers below its bytes need 32 bits
        del begins, offsets, data, plain
        # entries of the table: the runs, the whole texts and the end
        entries = [*self._of_runs(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), *whole, end]
        codes = np.empty(int(n.sum()), dtype=np.int32)
        of_run = np.repeat(by_run, n)
        codes[of_run] = coded.indices.to_numpy()
        codes[~of_run] = len(entries) - 1 - len(whole) + np.arange(len(whole))
        del coded, of_run
        codes = np.insert(codes, np.cumsum(n), len(entries) - 1)
        sizes = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries)) // 4
        table = np.frombuffer(b"".join(entries) or bytearray(), dtype="<i4")
        kind = np.int32 if max(len(table), int(sizes[codes].sum())) < 2**31 else np.int64
        firsts, size = (np.cumsum(sizes) - sizes).astype(kind)[codes], sizes.astype(kind)[codes]
        last = np.cumsum(size, dtype=kind)
        firsts -= last
        firsts += size
        at = np.repeat(firsts, size)
        at += np.arange(len(at), dtype=kind)
        return table[at], np.diff(last[np.cumsum(n + 1) - 1].astype(np.int64), prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        ids, n = self.encode_all(pa.array(texts, pa.string()))
        to = np.cumsum(n)
        return [ids[a:b].tobytes() for a, b in zip(to - n, to)]


def _batches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``CHUNK_BYTES``; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        low = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK_BYTES, "right")))
        yield at, to
        at = to


def _encoder(tokenizer_json: str) -> _Encoder:
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = (_Encoder(tokenizer_json),)
    return _encoders[key][0]


def _forget_encoders() -> None:
    """Give the memory of a worker's tokenizer and runs back; the next text to encode loads it again."""
    _encoders.clear()
    release_memory()


def encode_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """Token ids of rows that are range-partitioned and sorted by ``doc_id``.

    Each row gets its partition's number and the count of ids before it in that partition.
    """
    content = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # a worker may come from another stage, with what that left
        release_memory()
        encoder = _encoder(content.value)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, to in _batches(batch.column(1)):
                rows = batch.slice(at, to - at)
                found, n = encoder.encode_all(rows.column(1), end)
                ends = np.cumsum(n)
                ids = pa.array(found)
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array(np.full(len(n), part, dtype=np.int32)),
                        pa.array(before + ends - n),
                        pa.array(n),
                        pa.ListArray.from_arrays(offsets, ids),
                    ],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                before += int(n.sum())
        release_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, _SCHEMA.format(id=kind))


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text and write the ids in ascending id order.

    Ids are dictionary-encoded lists (a page of 16-bit codes), ids of documents
    and positions delta-encoded; row groups hold ``ROW_GROUP_BYTES`` and pages
    ``PAGE_BYTES``, with the page indexes that Parquet writers add, so a reader
    gets the lengths without the ids, or some documents without the others. Null
    texts are empty and get the end id only. Rows with a null id come first;
    repeated ids are ordered by a hash of the text. An empty table gives an empty folder
    that still reads with the declared columns. Other columns are ignored. A text of any length
    is encoded whole, one longer than ``CHUNK_BYTES`` alone.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (
        encode_tokens(dealt, tokenizer, end_id)
        .write.mode("overwrite")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#part_start", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids``: start counts the ids of all documents before.

    Only lengths are read for the starts; select without ``ids`` to read no ids.
    """
    rows = spark.read.schema(_SCHEMA.format(id=id_type)).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("part_first"))
    # one row per written part
    return rows.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("part_first") + F.col("part_start")).alias("start"), "n_tokens", "ids"
    )


def with_crc32(tokens: DataFrame) -> DataFrame:
    """Replace ``ids`` by the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker may come from the stage that encoded
        _forget_encoders()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            values = ids.values.to_numpy().astype("<i4", copy=False)
            offsets = ids.offsets.to_numpy().tolist()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            others = [(batch.column(i), n) for i, n in enumerate(batch.schema.names) if n != "ids"]
            yield pa.RecordBatch.from_arrays(
                [*(c for c, _ in others), pa.array(crc, type=pa.int64())], names=[*(n for _, n in others), "ids_crc32"]
            )
        release_memory()

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema if f.name != "ids"]
    return tokens.mapInArrow(run, ", ".join([*fields, "ids_crc32 bigint"]))
