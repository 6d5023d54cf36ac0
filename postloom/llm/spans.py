"""Positions of pattern matches as DataFrame expressions.

Spans are structs ``start, end, value`` with code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A code point that is no character; in a text it is read as another such.
MARK, OTHER_MARK = "￿", "￾"

SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_text(text: str) -> Column:
    """Null as empty, and no mark inside."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.when(whole.contains(MARK), F.translate(whole, MARK, OTHER_MARK)).otherwise(whole)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def running_starts(lengths: Column) -> Column:
    """Sum of the lengths before each; in blocks, so long arrays take n^1.5 steps."""

    def in_blocks(values: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), width - 1), lambda b: F.slice(values, b * width + 1, width))

        def placed(parts: Column) -> Column:
            def with_sums(sums: Column) -> Column:
                def one(block: Column, b: Column) -> Column:
                    return let(
                        _sum(F.slice(sums, 1, b)),
                        lambda before: F.transform(block, lambda _, j: before + _sum(F.slice(block, 1, j))),
                    )

                return F.flatten(F.transform(parts, one))

            return let(F.transform(parts, _sum), with_sums)

        return let(blocks, placed)

    return let(lengths, in_blocks)


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at the matches: every second piece, from the second on, is a match."""
    return F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def placed_pieces(text: Column, pattern: str) -> Column:
    """All pieces as spans; none if nothing matches."""

    def place(cut: Column) -> Column:
        lengths = F.transform(cut, lambda p: F.length(p).cast("long"))
        return let(
            running_starts(lengths),
            lambda starts: F.transform(
                cut,
                lambda p, i: F.struct(
                    F.get(starts, i).alias("start"),
                    (F.get(starts, i) + F.length(p)).alias("end"),
                    p.alias("value"),
                ),
            ),
        )

    none = F.expr(f"CAST(array() AS {SPAN})")
    return F.when(text.rlike(pattern), let(pieces(text, pattern), place).cast(SPAN)).otherwise(none)


def odd(placed: Column) -> Column:
    """The matches among placed pieces."""
    return F.filter(placed, lambda _, i: i % 2 == 1)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches."""
    return let(placed_pieces(text, pattern), odd)


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (span["start"] < o["end"]) & (span["end"] > o["start"]))


def labelled(spans: Column, kind: str, order: int) -> Column:
    """Spans with their kind, in a form that sorts by start and then by the order of kinds."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted labelled spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with sorted spans replaced; of overlapping spans the first counts."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        grown = F.struct(F.concat(acc["done"], between, by(s)).alias("done"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], grown).otherwise(acc)

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substr(text, (acc["at"] + 1).cast("int"))))
