"""Conversation structure repair by a dynamic program with square-root checkpoints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import stage

#: Costs of the edits; a kept or reroled row that is cut off adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}

#: Shortest distance of two checkpoints.
LEAST_SPACING = 64

VISIBLE = r"[^\x20\x09-\x0D]"
WHOLE = r"[.!?][\x20\x09-\x0D]*\z"

# A row's code: initial s, u, a or other, plus 4 if it is cut off, or plus 8 if it has to go; 12 is no row.
_NO_ROW = 12
_LETTERS = "suaoSUAO1234"

# States: nothing yet, after s, after u, after a. A row of role u or a leads to these, from each state:
_NEXT = np.array([2, 2, 3, 2])
_FAR = 1 << 40
_END = [0, 2 * INSERT, INSERT, 0]

# The state that keeping a row leads to, by initial and state; -1 is none.
_KEEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])


def _step(after: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Costs before a row from those after it: arrays of (block, state, column)."""
    fault, initial = codes // 4, codes % 4
    extra = np.where(fault == 1, TRUNCATED, 0)[:, None, None]
    to = _KEEP[initial]
    kept = np.where(to[:, :, None] >= 0, np.take_along_axis(after, np.maximum(to, 0)[:, :, None], 1), _FAR)
    stays = np.minimum(kept, after[:, _NEXT] + REROLE) + extra
    raw = np.minimum(after + DELETE, np.where((fault == 2)[:, None, None], _FAR, stays))
    out = np.minimum(raw, INSERT + raw[:, _NEXT])
    out[:, :2] = np.minimum(raw[:, :2], INSERT + out[:, 2:3])  # further inserts may follow
    return np.minimum(np.where((codes == _NO_ROW)[:, None, None], after, out), _FAR)


def _coded(texts: list[str]) -> np.ndarray:
    """(position, block) codes of blocks of rows, aligned at their ends."""
    longest = max(map(len, texts), default=0)
    out = np.full((longest, len(texts)), _NO_ROW, dtype=np.int64)
    for k, text in enumerate(texts):
        out[longest - len(text) :, k] = [_LETTERS.index(c) for c in text]
    return out


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the costs from each state before it to each state after it, 16 in a list."""
    unit = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for batch in batches:
        codes = _coded(batch["codes"].to_pylist())
        costs = np.repeat(unit[None], batch.num_rows, axis=0)
        for row in codes[::-1]:
            costs = _step(costs, row)
        flat = pa.array(costs.reshape(-1, 16).tolist(), pa.list_(pa.int64()))
        yield pa.record_batch({"conv_id": batch["conv_id"], "block": batch["block"], "codes": batch["codes"], "costs": flat})


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's transfers the cost vector after each of its blocks, and its whole cost."""
    for batch in batches:
        conv, block, after, last, cost = [], [], [], [], []
        for conv_id, blocks in zip(batch["conv_id"].to_pylist(), batch["blocks"].to_pylist()):
            costs = _END
            for k, b in enumerate(reversed(blocks)):
                conv.append(conv_id)
                block.append(b["block"])
                after.append(costs)
                last.append(k == 0)
                costs = [min(b["costs"][4 * s + t] + costs[t] for t in range(4)) for s in range(4)]
                cost.append(costs[0] if k == len(blocks) - 1 else None)
        yield pa.record_batch(
            {
                "conv_id": pa.array(conv, pa.int64()),
                "block": pa.array(block, pa.int64()),
                "after": pa.array(after, pa.list_(pa.int64())),
                "last": pa.array(last, pa.bool_()),
                "cost": pa.array(cost, pa.int64()),
            }
        )


def _walk(codes: str, costs: list, state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least edits along tight costs through a block, and the state after it.

    ``costs`` holds the vector before each row and the one after the last.
    """
    out = []
    for i, code in enumerate(codes):
        fault, initial = divmod(_LETTERS.index(code), 4)
        extra = TRUNCATED if fault == 1 else 0
        here, after = costs[i], costs[i + 1]
        while True:
            to, left = int(_NEXT[state]), here[state]
            if DELETE + after[state] == left:
                out.append("D")
                break
            if INSERT + here[to] == left:
                out.append("I")
                state = to
                continue
            kept = int(_KEEP[initial][state])
            if kept >= 0 and extra + after[kept] == left:
                out.append("K")
                state = kept
            else:
                out.append("R")
                state = to
            break
    if last:
        while costs[-1][state]:
            out.append("I")
            state = int(_NEXT[state])
    return "".join(out), state


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's vectors, recomputed from the checkpoint after it; its edits and exit for each state before it."""
    for batch in batches:
        texts = batch["codes"].to_pylist()
        codes = _coded(texts)
        now = np.array(batch["after"].to_pylist(), dtype=np.int64).reshape(-1, 4, 1)
        vectors = [now[:, :, 0]]
        for row in codes[::-1]:
            now = _step(now, row)
            vectors.append(now[:, :, 0])
        table = np.stack(vectors[::-1], axis=1)
        audits, exits = [], []
        for k, (text, last) in enumerate(zip(texts, batch["last"].to_pylist())):
            costs = table[k, len(vectors) - 1 - len(text) :].tolist()
            found = [_walk(text, costs, state, last) for state in range(4)]
            audits.append([a for a, _ in found])
            exits.append([e for _, e in found])
        yield pa.record_batch(
            {
                "conv_id": batch["conv_id"],
                "block": batch["block"],
                "audits": pa.array(audits, pa.list_(pa.string())),
                "exits": pa.array(exits, pa.list_(pa.int32())),
            }
        )


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each block of a conversation, from the blocks' exits."""
    for batch in batches:
        block, states = [], []
        for blocks in batch["blocks"].to_pylist():
            state = 0
            for b in blocks:
                block.append(b["block"])
                states.append(state)
                state = b["exits"][state]
        yield pa.record_batch({"block": pa.array(block, pa.int64()), "state": pa.array(states, pa.int32())})


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per edit but deletions: the row it is at, its place there, and the role that comes out, if new."""
    for batch in batches:
        out: dict[str, list] = {"conv_id": [], "seq": [], "place": [], "edit": [], "role": []}
        for conv_id, block, state, audit, kept in zip(*(batch[c].to_pylist() for c in ("conv_id", "block", "state", "audit", "codes"))):
            row = place = 0
            for edit in audit:
                if edit != "D":
                    code = _LETTERS.index(kept[row]) % 4 if row < len(kept) else 3
                    state = int(_KEEP[code][state]) if edit == "K" else int(_NEXT[state])
                    role = None if edit == "K" else ROLES["u" if state == 2 else "a"]
                    for c, v in zip(out, (conv_id, block + row, place, edit, role)):
                        out[c].append(v)
                place += 1
                if edit != "I":
                    row, place = row + 1, 0
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})


def _numbered(spacing: int):
    """Number a task's sorted rows, and start a block at each conversation and after ``spacing`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 40
        at, block, length = object(), 0, 0
        for batch in batches:
            blocks = []
            for conv_id in batch["conv_id"].to_pylist():
                if conv_id != at or length == spacing:
                    at, block, length = conv_id, seq + len(blocks), 0
                length += 1
                blocks.append(block)
            columns = {c: batch[c] for c in batch.schema.names}
            columns["seq"] = pa.array(np.arange(seq, seq + len(blocks)), pa.int64())
            columns["block"] = pa.array(blocks, pa.int64())
            seq += len(blocks)
            yield pa.record_batch(columns)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's newline-joined lines, which come sorted; one line is held at a time."""
    at, digest = None, None
    for batch in batches:
        conv, hashes = [], []
        for conv_id, line in zip(batch["conv_id"].to_pylist(), batch["line"]):
            if digest is not None and conv_id == at:
                digest.update(b"\n")
            else:
                if digest is not None:
                    conv.append(at)
                    hashes.append(digest.hexdigest())
                at, digest = conv_id, hashlib.sha256()
            digest.update(line.as_py())
        yield pa.record_batch({"conv_id": pa.array(conv, pa.int64()), "repaired_sha256": pa.array(hashes, pa.string())})
    if digest is not None:
        yield pa.record_batch({"conv_id": pa.array([at], pa.int64()), "repaired_sha256": pa.array([digest.hexdigest()])})


def _or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` with the faults that the checksum of ``conv_id:turn`` picks.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 takes `[.!?]` out of
    it, 3 repeats the row, 4 makes it a user's. Nulls are one space, in the
    checksum's text too; ids and turns themselves stay null.
    """
    key = F.concat_ws(":", _or_space("conv_id"), _or_space("turn"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _or_space("role").alias("role"),
        _or_space("text").alias("text"),
        (F.crc32(F.encode(key, "UTF-8")) % 20).alias("fault"),
    ).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
    return (
        rows.withColumn("text", text.otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
        .withColumn("_copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .drop("fault", "_copy")
    )


class Repair:
    """The parts of a repair; see ``repair``."""

    def __init__(self, rows: DataFrame, coded: DataFrame, blocks: DataFrame):
        self._rows, self._coded, self._blocks = rows, coded, blocks

    def repaired(self) -> DataFrame:
        """``conv_id, seq, place, edit, role, text``: the repaired conversations, in the order of seq and place."""
        edits = self._blocks.select("conv_id", "block", "state", "audit", "codes").mapInArrow(
            _edits, "conv_id long, seq long, place long, edit string, role string"
        )
        edits = stage(edits, "edits")
        own = self._rows.select("seq", F.col("role").alias("own_role"), "text")
        same = edits.where("edit <> 'I'").join(own, "seq")
        new = edits.where("edit = 'I'").withColumns({"own_role": F.lit(""), "text": F.lit("")})
        columns = ("conv_id", "seq", "place", "edit", F.coalesce("role", "own_role").alias("role"), "text")
        return same.select(*columns).unionByName(new.select(*columns))

    def repaired_hashes(self) -> DataFrame:
        """``conv_id, repaired_sha256`` of the conversations that have repaired rows.

        A hash of one text is serial: a conversation streams through one task in
        sorted order, which holds one row of it at a time.
        """
        line = F.concat_ws(":", "role", "text").cast("binary").alias("line")
        return (
            self.repaired()
            .select("conv_id", "seq", "place", line)
            .repartition("conv_id")
            .sortWithinPartitions("conv_id", "seq", "place")
            .select("conv_id", "line")
            .mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
        )

    def audits(self) -> DataFrame:
        """``conv_id, cost, audit``."""
        pieces = F.array_sort(F.collect_list(F.struct("block", "audit")))
        return self._blocks.groupBy("conv_id").agg(
            F.max("cost").alias("cost"),
            F.array_join(F.transform(pieces, lambda x: x.audit), "").alias("audit"),
        )

    def faults(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated, illegal``."""
        turns = self._coded.groupBy("conv_id", "turn").count().groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
        )
        counts = self._coded.groupBy("conv_id").agg(
            F.count_if("blank").alias("blank"), F.count_if("duplicate").alias("duplicate"), F.count_if("truncated").alias("truncated")
        )
        within = F.regexp_replace(F.lower(F.translate("codes", "1234", "suao")), "(?=su|ua|au)", ":")
        inner = F.length("codes") - 1 - (F.length(within) - F.length("codes"))
        # between the blocks of a conversation, of which there are few
        before = F.lag("codes").over(Window.partitionBy("conv_id").orderBy("block"))
        meet = F.lower(F.translate(F.concat(F.right(before, F.lit(1)), F.left("codes", F.lit(1))), "1234", "suao"))
        outer = F.coalesce(F.when(meet.isin("su", "ua", "au"), 0).otherwise(F.when(before.isNull(), 0).otherwise(1)), F.lit(0))
        ends = F.concat(F.left("codes", F.lit(1)), F.right("codes", F.lit(1)))
        illegal = (
            self._blocks.select("conv_id", "block", inner.alias("inner"), ends.alias("codes"))
            .withColumn("outer", outer)
            .groupBy("conv_id")
            .agg(F.sum(F.col("inner") + F.col("outer")).alias("illegal"))
        )
        return _per_conversation([turns, counts, illegal])


def _per_conversation(frames: list[DataFrame]) -> DataFrame:
    """One row per conv_id, null too, with the columns of all frames; each has at most one row of an id."""
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame, allowMissingColumns=True)
    return every.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in every.columns if c != "conv_id"))


def repair(conversations: DataFrame) -> Repair:
    """Cheapest edits that give every conversation roles of the form ``(s?(ua)+)?``.

    Rows of ``conv_id, turn, role, text`` are taken by turn, nulls first, ties by
    role and text (their first 100 characters, then a digest). A row's first
    fault counts: blank, then duplicate (an earlier row has its role and text),
    then truncated (the last visible character is none of ``.!?``). Edits are
    Keep, Rerole to user or assistant, Delete, Insert of an empty row; blank and
    duplicate rows must be deleted, truncated ones that stay cost more.

    The state is what the roles so far end in. Backward vectors of the cost from
    each state are stored only at checkpoints, the square root of the longest
    conversation's rows apart (``LEAST_SPACING`` at least). A task takes blocks
    between checkpoints: first their transfers, the costs from any state before
    to any state after, which a small step per conversation chains from the end
    into the vectors at the checkpoints; then it recomputes a block's vectors from
    the checkpoint after it and walks forward from each state along tight edits,
    Delete before Insert, Keep and Rerole, which is ASCII order; the states
    before the blocks follow from their exits. So a task holds blocks, and a
    group one small record per block, also where one conversation has most rows.

    Null roles and texts are one space; an empty role has no initial and cannot
    be kept. A null conv_id is a conversation. Very long texts are only matched
    and hashed. Repeated rows are rows. Other columns are ignored; an empty table
    gives empty results. Beyond 2^40 rows to a task numbers would run over.
    """
    text, role = _or_space("text"), _or_space("role")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    ).withColumns(
        {
            "digest": F.unhex(F.sha2(F.concat_ws(":", _or_space("conv_id"), F.length("role").cast("string"), "role", "text"), 256)),
            "role_start": F.left("role", F.lit(100)),
            "text_start": F.left("text", F.lit(100)),
            "spread": F.monotonically_increasing_id(),
        }
    )
    longest = rows.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    spacing = max(LEAST_SPACING, isqrt(longest))
    order = ["conv_id", "turn", "role_start", "text_start", "digest", "spread"]
    kept = ["conv_id", "turn", "role", "text", "digest"]
    types = "conv_id long, turn long, role string, text string, digest binary, seq long, block long"
    rows = stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*kept).mapInArrow(_numbered(spacing), types), "turns"
    )
    firsts = stage(
        rows.groupBy("digest").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-turns"
    )
    narrow = rows.select(
        "conv_id",
        "turn",
        "seq",
        "block",
        "digest",
        F.coalesce(F.nullif(F.position(F.left("role", F.lit(1)), F.lit("sua")), F.lit(0)), F.lit(4)).alias("initial"),
        (F.length("role") == 0).alias("no_role"),
        (~F.col("text").rlike(VISIBLE)).alias("blank"),
        (~F.col("text").rlike(WHOLE)).alias("open"),
    )
    repeats = ~F.col("blank") & F.coalesce(F.col("seq") > F.col("first"), F.lit(False))
    coded = stage(
        narrow.join(firsts, "digest", "left")
        .withColumn("duplicate", repeats)
        .withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open"))
        .withColumn("initial", F.when(F.col("no_role"), 4).otherwise(F.col("initial")).cast("int"))
        .withColumn(
            "code",
            F.substring(
                F.lit(_LETTERS),
                F.col("initial") + F.when(F.col("blank") | F.col("duplicate"), 8).when(F.col("truncated"), 4).otherwise(0),
                F.lit(1),
            ),
        )
        .select("conv_id", "turn", "seq", "block", "blank", "duplicate", "truncated", "code"),
        "coded-turns",
    )
    in_order = F.array_sort(F.collect_list(F.struct("seq", "code")))
    blocks = coded.groupBy("conv_id", "block").agg(F.array_join(F.transform(in_order, lambda x: x.code), "").alias("codes"))
    blocks = stage(blocks.mapInArrow(_transfers, "conv_id long, block long, codes string, costs array<long>"), "blocks")

    def by_conversation(frame: DataFrame, what: str) -> DataFrame:
        return frame.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", what))).alias("blocks"))

    ends = by_conversation(blocks, "costs").mapInArrow(
        _checkpoints, "conv_id long, block long, after array<long>, last boolean, cost long"
    )
    ended = stage(blocks.drop("costs").join(ends.drop("conv_id"), "block"), "checkpoints")
    walks = stage(
        ended.select("conv_id", "block", "codes", "after", "last").mapInArrow(
            _walks, "conv_id long, block long, audits array<string>, exits array<int>"
        ),
        "walks",
    )
    states = by_conversation(walks, "exits").select("blocks").mapInArrow(_entered, "block long, state int")
    audit = F.element_at("audits", F.col("state") + 1).alias("audit")
    chosen = walks.join(states, "block").select("block", "state", audit)
    return Repair(rows, coded, stage(ended.select("conv_id", "block", "codes", "cost").join(chosen, "block"), "audits"))


def audited(conversations: DataFrame, original: DataFrame) -> DataFrame:
    """One row per conv_id of ``original``: the faults, the cost, the edits and the hash of what is repaired.

    Conversations without rows have zeros, no edits and the hash of an empty text.
    """
    found = repair(conversations)
    ids = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = _per_conversation([ids, found.faults(), found.audits(), found.repaired_hashes()])
    zeros = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zeros),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
