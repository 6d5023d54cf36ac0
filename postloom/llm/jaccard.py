"""N-gram Jaccard join by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import (
    SIMILARITY,
    attach,
    bitmap,
    filter_bits,
    filter_positions,
    hashed_words,
    mix64,
    release_memory,
    shingles,
    stage,
    text_chunks,
    with_filter,
)

#: Buckets of up to so many texts are compared pair by pair; larger ones are split once more.
BUCKET = 200
#: Tokens that a path has at most.
DEPTH = 3
#: Share of the linked pairs that meet in some bucket.
RECALL = 0.9999

#: Cells of the token matrix that a comparison holds at a time.
CELLS = 4 << 20


def runs_needed(similarity: float, depth: int, recall: float) -> int:
    """Two sets share each chosen token with probability ``similarity``, so a whole path with its power."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth)))


def meetings_needed(similarity: float, runs: int, loss: float) -> int:
    """The most first tokens that two similar sets share but for a probability of ``loss``."""
    fewer, m = 0.0, 0
    while m < runs:
        fewer += math.comb(runs, m) * similarity**m * (1 - similarity) ** (runs - m)
        if fewer > loss:
            break
        m += 1
    return max(1, m)


def _seeds(runs: int, depth: int) -> np.ndarray:
    return mix64(np.arange(1, runs * depth + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _chosen(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each seed the smallest of the set's tokens under its hash."""
    out = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(tokens), 1 << 15):
        out = np.minimum(out, mix64(tokens[at : at + (1 << 15)] ^ seeds[:, None]).min(axis=1))
    return out


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text."""
    for _, held in text_chunks(texts):
        every, n = shingles(*hashed_words(held))
        for own in np.split(every, np.cumsum(n)[:-1]):
            yield np.unique(own)


def _copy_key(tokens: np.ndarray) -> bytes:
    """128 bits that texts of the same shingle set share."""
    with_sum = [np.uint64(len(tokens)) + mix64(tokens ^ np.uint64(s)).sum(dtype=np.uint64) for s in (1, 2)]
    return mix64(np.array(with_sum, dtype=np.uint64)).tobytes()


def _signatures(rows: DataFrame, seeds: np.ndarray, with_tokens: bool) -> DataFrame:
    """``doc_id, copy_key, n_tokens, chosen`` (and ``tokens``) of ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, sizes, chosen, tokens = [], [], [], []
                for own in _sets(part.column(1).to_pylist()):
                    keys.append(_copy_key(own) if len(own) else None)
                    sizes.append(len(own))
                    chosen.append(_chosen(own, seeds).view(np.int64) if len(own) else [])
                    if with_tokens:
                        tokens.append(own.view(np.int64))
                columns = {
                    "doc_id": part.column(0),
                    "copy_key": pa.array(keys, pa.binary()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "chosen": pa.array(chosen, pa.list_(pa.int64())),
                }
                if with_tokens:
                    columns["tokens"] = pa.array(tokens, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)
        release_memory()

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, copy_key binary, n_tokens bigint, chosen array<bigint>"
    return rows.mapInArrow(run, schema + ", tokens array<bigint>" * with_tokens)


def _meeting(rows: DataFrame, total: int) -> DataFrame:
    """The rows whose path some other set shares, with the number of sets on it."""
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("on_path")).where("on_path > 1")
    return attach(rows, sizes, ["path"], "on_path", total)


def _intersections(tokens: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices of bounded size."""
    m = len(tokens)
    if m == 2:
        n = len(np.intersect1d(tokens[0], tokens[1], assume_unique=True))
        return np.array([[len(tokens[0]), n], [n, len(tokens[1])]], dtype=np.float32)
    every = np.concatenate(tokens)
    owner = np.repeat(np.arange(m), [len(t) for t in tokens])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    column = np.cumsum(np.concatenate(([0], every[1:] != every[:-1])))
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    out = np.zeros((m, m), dtype=np.float32)
    if len(column):
        column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
        width = max(1, CELLS // m)
        for low in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [low, low + width])
            cells = np.zeros((m, width), dtype=np.float32)
            cells[owner[a:b], column[a:b] - low] = 1
            out += cells @ cells.T
    return out


def _components(linked: np.ndarray) -> np.ndarray:
    """The smallest index of each member's component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(group: pa.Table, similarity: float) -> dict:
    """Links of one bucket, or of one pair of blocks of it.

    A pair that also meets in an earlier run is counted there, so the sums over
    all buckets count each link once.
    """
    keys = group.column("copy_key").to_pylist()
    tokens = [np.asarray(t.values) for t in group.column("tokens")]
    homes = np.array(group.column("homes").to_pylist(), dtype=np.int64)
    copies = group.column("copies").to_numpy().astype(np.int64)
    block = group.column("block").to_numpy()
    run = group.column("run")[0].as_py()
    n = np.array([len(t) for t in tokens], dtype=np.float64)
    common = _intersections(tokens).astype(np.float64)
    linked = common / (n[:, None] + n[None, :] - common) >= similarity
    np.fill_diagonal(linked, False)
    if len(np.unique(block)) > 1:
        linked &= block[:, None] != block[None, :]
    first = linked.copy()
    for earlier in range(run):
        at = homes[:, earlier]
        first &= ~((at[:, None] == at[None, :]) & (at != 0)[:, None])
    root = _components(linked)
    some = np.flatnonzero(linked.any(axis=1))
    return {
        "copy_key": [keys[i] for i in some],
        "root": [keys[i] for i in root[some]],
        "linked_docs": (first[some] * copies[None, :]).sum(axis=1),
        "linked_texts": first[some].sum(axis=1),
    }


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches; a run may cross batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        at, low = list(zip(*columns)), 0
        for i, key in enumerate(at):
            if key != last:
                if i > low:
                    held.append(pa.Table.from_batches([batch.slice(low, i - low)]))
                if held:
                    yield pa.concat_tables(held)
                held, low, last = [], i, key
        if len(at) > low:
            held.append(pa.Table.from_batches([batch.slice(low)]))
    if held:
        yield pa.concat_tables(held)


def _bucket_links(members: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["path", "left", "right"]):
            found = _compare(group.combine_chunks(), similarity)
            if found["copy_key"]:
                yield pa.RecordBatch.from_pydict(
                    {
                        "copy_key": pa.array(found["copy_key"], pa.binary()),
                        "root": pa.array(found["root"], pa.binary()),
                        "linked_docs": pa.array(found["linked_docs"], pa.int64()),
                        "linked_texts": pa.array(found["linked_texts"], pa.int64()),
                    }
                )
        release_memory()

    # keys in order, so that every root is the smallest of its component
    dealt = members.repartition("path", "left", "right").sortWithinPartitions("path", "left", "right", "copy_key")
    return dealt.mapInArrow(run, "copy_key binary, root binary, linked_docs bigint, linked_texts bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each component, from edges ``a, b``.

    Each round takes the smallest label around a node, then the label of that
    label. Rounds are written out, so lineage stays short.
    """
    both = stage(
        edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")),
        "labels",
    )
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("next"))
        jumps = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        moved = stage(
            lower.join(jumps, "next", "left").select(
                "node", F.coalesce("jump", "next").alias("label"), (F.col("label") != F.coalesce("jump", "next")).alias("changed")
            ),
            "labels",
        )
        labels = moved.select("node", "label")
        if not moved.where("changed").take(1):
            return labels


def _homes(runs: int) -> list[Column]:
    return [F.coalesce(F.max(F.when(F.col("run") == r, F.col("path"))), F.lit(0)) for r in range(runs)]


def similar_documents(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    bucket: int = BUCKET,
    depth: int = DEPTH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """For each document its group and how many others have a Jaccard similarity of at least ``similarity``.

    Sets are the distinct five-word shingles of lower-cased words. Texts of one set form a copy class, and
    only one set per class is joined. In each run a set follows one path: it goes
    to the bucket of the token of its own that is smallest under the run's hash; a bucket of more
    than ``bucket`` sets is split again by the next such token, up to ``depth``.
    Two sets share a token with the probability of their similarity; the number of
    runs follows from that and ``recall``, and so does the number of runs in which a
    set must meet others at all to be looked at further. Small buckets are compared pair by
    pair on the whole sets; a bucket that is still larger after ``depth`` tokens is cut into
    blocks, and every pair of blocks is compared in a task of its own, so nothing
    is left out. Tasks return sums and star edges, never pairs.

    Result: ``doc_id, class_id, copy_id, n_copies, n_links, n_linked_texts`` per
    input row. ``class_id`` is the smallest id of the documents connected by links,
    ``copy_id`` that of the same set, ``n_copies`` counts the class of copies,
    ``n_links`` the other documents that link, copies included, and
    ``n_linked_texts`` the other sets. A text of one to four words has one shingle;
    a text without words (null, empty) links to nothing, its ``class_id`` and ``copy_id``
    are its own id. Null ids count as rows, and are a class id only where no
    member has one. ``copy_key`` and ``class_key`` are the sets of the row and of the document named by
    ``class_id``, null without words. Repeated rows are copies. Other columns are ignored; an empty table
    gives an empty result.
    """
    runs = runs_needed(similarity, depth, recall)
    seeds = _seeds(runs, depth)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(_signatures(rows, seeds[:runs], with_tokens=False), "signed")
    total = signed.count()

    reps = stage(
        signed.where("copy_key IS NOT NULL")
        .groupBy("copy_key")
        .agg(
            F.min("doc_id").alias("copy_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("chosen").alias("chosen"),
        ),
        "reps",
    )
    paths = reps.select("copy_key", F.posexplode("chosen").alias("run", "token")).select(
        "copy_key", "run", F.xxhash64("run", "token").alias("path")
    )
    level = stage(_meeting(paths, total * runs), "level")
    # similar sets meet in most runs, sets that just share a line in few
    needed = meetings_needed(similarity, runs, (1 - recall) / 5)
    often = level.groupBy("copy_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= needed)
    level = stage(_meeting(level.drop("on_path").join(often.select("copy_key"), "copy_key", "left_semi"), total * runs), "level")

    # whole sets of the texts that met another one; the others never travel
    met = stage(level.select("copy_key").distinct().join(reps, "copy_key").select("copy_key", "copy_id", "copies"), "met")
    bits = filter_bits(met.count())
    wanted = met.select(F.explode(F.array(*filter_positions(F.col("copy_id"), bits))).alias("position"))
    near = with_filter(rows, F.col("doc_id"), bits, bitmap(wanted), "wanted").where("wanted").drop("wanted")
    sets = stage(
        _signatures(near, seeds[runs:], with_tokens=True)
        .join(met, "copy_key", "left_semi")
        .select("copy_key", "chosen", "tokens")
        .dropDuplicates(["copy_key"]),
        "sets",
    )

    final = None
    for step in range(1, depth + 1):
        done = level if step == depth else level.where(F.col("on_path") <= bucket)
        final = done if final is None else final.unionByName(done)
        if step == depth:
            break
        deeper = level.where(F.col("on_path") > bucket).join(sets.select("copy_key", "chosen"), "copy_key")
        token = F.element_at("chosen", F.col("run") + F.lit((step - 1) * runs + 1))
        level = stage(
            _meeting(deeper.select("copy_key", "run", F.xxhash64("path", token).alias("path")), total * runs), "level"
        )
        if not level.take(1):
            break
    final = stage(final.select("copy_key", "run", "path", "on_path"), "final")

    # the same members may meet in several runs: once is enough
    buckets = final.groupBy("path").agg(
        F.min("run").alias("run"),
        F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("copy_key")).alias("one"),
        F.bit_xor(F.xxhash64("copy_key", F.lit(1))).alias("two"),
    )
    once = buckets.groupBy("size", "one", "two").agg(F.min(F.struct("run", "path")).alias("at")).select("size", "at.path")
    homes = final.groupBy("copy_key").agg(F.array(*_homes(runs)).alias("homes"))
    members = (
        attach(final.drop("on_path"), once, ["path"], "size", total * runs)
        .join(homes, "copy_key")
        .join(met.select("copy_key", "copies"), "copy_key")
    )
    # blocks of a bucket that stayed large; a small bucket is one block against itself
    blocks = F.ceil(F.col("size") / F.lit(bucket)).cast("int")
    members = members.withColumn("block", F.pmod(F.xxhash64("copy_key", F.lit(7)), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))
    )
    members = members.select(
        "path", "run", "copy_key", "homes", "copies", "block",
        F.least("block", "other").alias("left"),
        F.greatest("block", "other").alias("right"),
    ).join(sets.select("copy_key", "tokens"), "copy_key")
    links = stage(_bucket_links(members, similarity), "links")

    labels = components(links.select(F.col("copy_key").alias("a"), F.col("root").alias("b")))
    sums = links.groupBy("copy_key").agg(F.sum("linked_docs").alias("docs"), F.sum("linked_texts").alias("texts"))
    linked = (
        sums.join(met.select("copy_key", "copy_id"), "copy_key")
        .join(labels.select(F.col("node").alias("copy_key"), "label"), "copy_key")
    )
    least = F.min(F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "copy_key")).alias("least")
    class_ids = linked.groupBy("label").agg(least)
    linked = linked.join(class_ids, "label").select(
        "copy_key", "docs", "texts",
        F.col("least.copy_id").alias("class_id"),
        F.col("least.copy_key").alias("class_key"),
    )
    classes = stage(
        reps.select("copy_key", "copy_id", "copies")
        .join(linked, "copy_key", "left")
        .select(
            "copy_key", "copy_id", "copies",
            F.when(F.col("docs").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("class_key", "copy_key").alias("class_key"),
            F.coalesce("docs", F.lit(0)).alias("docs"),
            F.coalesce("texts", F.lit(0)).alias("texts"),
        ),
        "classes",
    )
    found = attach(signed.select("doc_id", "copy_key"), classes, ["copy_key"], "copies", total).select(
        "doc_id", "class_id", "copy_id",
        F.col("copies").alias("n_copies"),
        (F.col("docs") + F.col("copies") - 1).alias("n_links"),
        F.col("texts").alias("n_linked_texts"),
        "copy_key", "class_key",
    )
    wordless = signed.where("copy_key IS NULL").select(
        "doc_id",
        F.col("doc_id").alias("class_id"),
        F.col("doc_id").alias("copy_id"),
        F.lit(1).cast("long").alias("n_copies"),
        F.lit(0).cast("long").alias("n_links"),
        F.lit(0).cast("long").alias("n_linked_texts"),
        "copy_key",
        F.col("copy_key").alias("class_key"),
    )
    return found.unionByName(wordless)


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows, with all their columns, that stay when one document of each group does: the smallest id.

    Rows that go are told by id and shingle set, so rows of one id with other
    texts are unaffected; of repeated rows one stays. A null id stays only where no
    member of the group has an id. Rows that a bitmap of these pairs rules out pass straight through.
    """
    found = stage(similar_documents(docs, id_col=id_col, text_col=text_col, **settings).where("copy_key IS NOT NULL"), "similar")
    pair = F.struct("doc_id", "copy_key")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("copy_key") == F.col("class_key"))
    gone = found.where(~stays).select("doc_id", "copy_key").distinct()
    repeated = found.groupBy("doc_id", "copy_key").count().where("count > 1").select("doc_id", "copy_key")
    gone, touched = stage(gone, "gone"), stage(gone.unionByName(repeated).distinct(), "touched")
    bits = filter_bits(touched.count())
    blocks = bitmap(touched.select(F.explode(F.array(*filter_positions(pair, bits))).alias("position")))

    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_copy_key(s) if len(s) else None for s in _sets(batch.column(at_text).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*names, "copy_key"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema)) + ", copy_key binary"
    keyed = plain.mapInArrow(run, schema)
    own = F.struct(F.col(names[at_id]).alias("doc_id"), "copy_key")
    marked = stage(with_filter(keyed, own, bits, blocks, "touched"), "marked")
    straight = marked.where(~F.col("touched") | F.col("copy_key").isNull()).select(*names)
    rest = (
        marked.where(F.col("touched") & F.col("copy_key").isNotNull())
        .join(
            gone.select(F.col("doc_id").alias("gone_id"), F.col("copy_key").alias("gone_key")),
            F.col(names[at_id]).eqNullSafe(F.col("gone_id")) & (F.col("copy_key") == F.col("gone_key")),
            "left_anti",
        )
        .dropDuplicates([names[at_id], "copy_key"])
        .select(*names)
    )
    return straight.unionByName(rest).toDF(*docs.columns)
