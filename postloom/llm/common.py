"""What several operators share: staged tables, joins with hot groups, bitmap filters, shingles."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SIMILARITY = 0.8

#: A hash of at least this share of the rows is hot; so there are at most 1 / HOT_SHARE hot ones.
HOT_SHARE = 0.001

#: Bits of the largest bitmap filter; 128 MB, the most that is broadcast.
MAX_FILTER_BITS = 1 << 30
BLOCK_BITS = 1 << 15

#: Bytes of text that are turned into arrays at a time.
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="postloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the frame once as Parquet into the shared folder and read it back.

    Lost executors then cost only their tasks, and what reads the result twice
    doesn't compute it twice.
    """
    return stage_at(df, fresh_path(df.sparkSession, name))


def stage_at(df: DataFrame, path: str) -> DataFrame:
    """The same at a path of ``fresh_path``, for a table that ``drop_stage`` takes away again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no frame in use reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that ended: it does so once their plans are collected as garbage."""
    spark.sparkContext._jvm.System.gc()


def attach(
    rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int
) -> DataFrame:
    """Inner join of rows with one row per group, of which some may be hot.

    Groups with more than ``HOT_SHARE`` of all rows number at most
    ``1 / HOT_SHARE``: they are broadcast, and their rows stay where they are.
    The other rows are shuffled by key, none of which is frequent.
    """
    threshold = max(2.0, total * HOT_SHARE)
    hot = F.broadcast(groups.where(F.col(size) > threshold))
    rest = groups.where(F.col(size) <= threshold)
    few = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(few.join(rest, keys))


def release_memory() -> None:
    """Give memory that a worker no longer uses back to the system; it may go on with another stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# bitmap filters


def filter_bits(n: int, per_item: int = 16) -> int:
    """A power of two of at least ``per_item * n`` bits, ``MAX_FILTER_BITS`` at most."""
    bits = BLOCK_BITS
    while bits < per_item * n and bits < MAX_FILTER_BITS:
        bits *= 2
    return bits


def filter_positions(key: Column, bits: int) -> list[Column]:
    """The two bits of a key."""
    return [F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in (1, 2)]


def bitmap(positions: DataFrame) -> DataFrame:
    """(block, bits) of a frame with a column ``position``: 4 KB for each block of 32,768 bits."""
    block, offset = F.shiftright("position", 15), F.col("position").bitwiseAND(F.lit(BLOCK_BITS - 1))
    return positions.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(offset).alias("bits"))


def with_filter(rows: DataFrame, key: Column, bits: int, blocks: DataFrame, name: str) -> DataFrame:
    """Add a boolean column: are both bits of the key set in the bitmap?

    The bitmap is broadcast; ``MAX_FILTER_BITS`` bounds it.
    """
    kept = rows.columns
    out = rows
    hits = F.lit(True)
    for i, position in enumerate(filter_positions(key, bits)):
        at = f"_at{i}"
        side = F.broadcast(
            blocks.select(F.col("block").alias(f"_block{i}"), F.col("bits").alias(f"_bits{i}"))
        )
        out = out.withColumn(at, position).join(
            side, F.shiftright(at, 15) == F.col(f"_block{i}"), "left"
        )
        offset = F.col(at).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
        byte = F.substring(f"_bits{i}", F.shiftright(offset, 3) + F.lit(1), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        bit = F.expr(f"shiftright({{}}, _at{i} & 7) & 1".format(f"_value{i}"))
        out = out.withColumn(f"_value{i}", value)
        hits = hits & (F.coalesce(bit, F.lit(0)) == 1)
    return out.select(*kept, hits.alias(name))


# words and shingles

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
WORD_PATTERN = re.compile(rb"[0-9a-z\x80-\xff]+")
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if len(table) <= 2 * CHUNK_BYTES:
            _powers[base] = table
    return table[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal_bytes(text: str | None) -> bytes:
    """Lower-cased UTF-8; null is empty."""
    return (text or "").lower().encode("utf-8", "surrogatepass")


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of the words: runs of ASCII letters, digits and non-ASCII bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class SpanHashes:
    """Hashes of any spans of some bytes, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_ODD, n), out=self.sums[1:])
        self.inverse = _power_table(_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix64(total + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, with prefix sums over about ``CHUNK_BYTES`` at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK_BYTES, "right")))
        hashes = SpanHashes(data[low : int(ends[to - 1])])
        out[at:to] = hashes.of(starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def text_chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``CHUNK_BYTES``, each with the index of its first; a longer text is alone."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = normal_bytes(text)
        if held and size + len(data) > CHUNK_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield first, held


def hashed_words(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some texts, and how many words each has."""
    data = np.frombuffer(b" ".join(held), dtype=np.uint8)
    starts, ends = word_spans(data)
    lengths = np.array([len(x) + 1 for x in held], dtype=np.int64)
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return word_hashes(data, starts, ends), np.diff(bounds)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, across text boundaries too."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = words[:n].copy()
    for j in range(1, size):
        total = total * _STEP + words[j : j + n]
    return mix64(total)


def shingles(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text in order, and how many each has.

    A text with fewer words than ``size`` has one shingle, of all its words; a
    text without words has none.
    """
    every = window_hashes(words, size)
    ends = np.cumsum(counts)
    firsts = ends - counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    where = np.repeat(firsts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    out = np.empty(len(where), dtype=np.uint64)
    whole = np.repeat(counts >= size, n)
    out[whole] = every[where[whole]]
    for length in range(1, size):
        at = firsts[counts == length]
        if len(at):
            total = words[at]
            for j in range(1, length):
                total = total * _STEP + words[at + j]
            out[(np.cumsum(n) - n)[counts == length]] = mix64(total + np.uint64(length))
    return out, n


def exact_shingles(text: str | None, size: int = SHINGLE_WORDS) -> set[bytes]:
    """The same shingles as plain bytes, for exact comparison."""
    words = WORD_PATTERN.findall(normal_bytes(text))
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
