"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import SIMILARITY, exact_shingles, hashed_words, shingles, text_chunks

#: Characters of test items that are searched in one pass over the documents.
BLOCK_CHARS = 16 << 20

_TABLE_BITS = 20


class ItemIndex:
    """MinHash signatures of test items, partitioned by size.

    A partition holds the items of 2^j to 2^(j+1) - 1 distinct shingles. Its
    signatures are the k smallest shingle hashes of an item, where k is one more
    than an item of that size may miss and still be contained at the threshold. So a
    document that contains an item shares a signature value with it for certain,
    however long it is. A document's sketch are its hashes up to a
    partition's largest signature value.
    """

    def __init__(self, texts: list[str | None], threshold: float):
        self.texts = texts
        self.threshold = threshold
        self.exact: dict[int, set[bytes]] = {}
        parts: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for first, held in text_chunks(texts):
            every, n = shingles(*hashed_words(held))
            for i, own in enumerate(np.split(every, np.cumsum(n)[:-1])):
                if len(own):
                    own = np.unique(own)
                    j = len(own).bit_length()
                    k = int((1 - threshold) * (2**j - 1) + 1e-9) + 1
                    parts[j].append((own[:k], first + i))
        self.parts = []
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        for _, held in sorted(parts.items()):
            values = np.concatenate([v for v, _ in held])
            owners = np.repeat([i for _, i in held], [len(v) for v, _ in held])
            order = np.argsort(values, kind="stable")
            self.parts.append((values[order], owners[order]))
            self.table[(values >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def candidates(self, every: np.ndarray, n: np.ndarray) -> dict[int, set[int]]:
        """Items that share a signature value, by text."""
        found: dict[int, set[int]] = defaultdict(set)
        at = np.flatnonzero(self.table[(every >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        if len(at):
            sketch, owner = every[at], np.searchsorted(np.cumsum(n), at, "right")
            for values, items in self.parts:
                low, high = np.searchsorted(values, sketch, "left"), np.searchsorted(values, sketch, "right")
                for hit in np.flatnonzero(high > low):
                    found[int(owner[hit])].update(items[low[hit] : high[hit]].tolist())
        return found

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, shingles of the item, those that the text has), verified on the words themselves."""
        for first, held in text_chunks(texts):
            for i, items in sorted(self.candidates(*shingles(*hashed_words(held))).items()):
                own = exact_shingles(texts[first + i])
                for item in sorted(items):
                    if item not in self.exact:
                        self.exact[item] = exact_shingles(self.texts[item])
                    wanted = self.exact[item]
                    common = len(wanted & own)
                    if common / len(wanted) >= self.threshold:
                        yield first + i, item, len(wanted), common


def _blocks(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, threshold: float) -> Iterator[Callable]:
    """For each block of items, a function that gives a task its item ids and index."""
    spark = docs.sparkSession
    own = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars // BLOCK_CHARS + 1
    for block in range(n):
        mine = own if n == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        rows = mine.collect()
        sent = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

        def index(sent=sent) -> tuple[list, ItemIndex]:
            ids, texts = sent.value
            return ids, ItemIndex(texts, threshold)

        yield index


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_item, n_found, containment`` of the test items that documents contain.

    An item is contained when the document has at least ``threshold`` of its
    distinct five-word shingles, wherever they stand. Candidates come from
    ``ItemIndex``, which misses none; each is verified on the words. The items
    are the query set: they go to every task in blocks of ``BLOCK_CHARS``, one pass over the
    documents each, and documents are never shuffled.

    An item of fewer than five words has one shingle, which only a text of the
    same words has; an item or text without words (null, empty) matches nothing. Repeated rows and
    null ids give their own rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    doc_kind, item_kind = rows.schema["doc_id"].dataType, items.schema[item_id].dataType
    schema = f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, n_item bigint, n_found bigint, containment double"

    def search(index: Callable) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, found = index()
            for batch in batches:
                hits = list(found.search(batch.column(1).to_pylist()))
                if hits:
                    row, item, n, common = (list(x) for x in zip(*hits))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": batch.column(0).take(pa.array(row)),
                            "item_id": [ids[i] for i in item],
                            "n_item": n,
                            "n_found": common,
                            "containment": [c / m for c, m in zip(common, n)],
                        }
                    )

        return rows.mapInArrow(run, schema)

    out = None
    for index in _blocks(docs, items, item_id, item_text, threshold):
        out = search(index) if out is None else out.unionByName(search(index))
    return out


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = SIMILARITY,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows, with all their columns, whose text contains no test item; as ``contained_items`` finds them."""
    at = docs.columns.index(text_col)
    kept = docs
    for index in _blocks(docs, items, item_id, item_text, threshold):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            _, found = index()
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[row for row, *_ in found.search(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(run, kept.schema)
    return kept
