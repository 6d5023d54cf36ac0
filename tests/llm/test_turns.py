from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from postloom.llm import turns
from postloom.llm.turns import audited, damaged, repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = text.rstrip(SPACE)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Shortest paths over (row, last role), by cost and then by the whole sequence of edits."""
    best, kinds = {}, faults(rows)
    todo = [(0, "", 0, "", [])]
    while todo:
        cost, audit, row, state, lines = heapq.heappop(todo)
        if (row, state) in best:
            continue
        best[row, state] = (cost, audit, lines)
        steps = [("I", row, x, 3, [f"{r}:"]) for x, r in (("u", "user"), ("a", "assistant"))]
        if row < len(rows):
            _, _, role, text = rows[row]
            steps.append(("D", row + 1, "", 4, []))
            if kinds[row] not in ("blank", "duplicate"):
                more = 3 * (kinds[row] == "truncated")
                steps.append(("K", row + 1, role[:1] or "?", more, [f"{role}:{text}"]))
                steps += [("R", row + 1, x, 3 + more, [f"{r}:{text}"]) for x, r in (("u", "user"), ("a", "assistant"))]
        for edit, to, role, more, line in steps:
            if not role or state + role in ("s", "u", "su", "ua", "au"):
                heapq.heappush(todo, (cost + more, audit + edit, to, role or state, lines + line))
    return min(best[at] for at in ((len(rows), ""), (len(rows), "a")) if at in best)


def brute(rows, original):
    out = []
    for conv in {r[0] for r in original}:
        mine = sorted(
            (r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
        )
        known = {r[1] for r in mine if r[1] is not None}
        kinds = faults(mine)
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        cost, audit, lines = cheapest(mine)
        out.append(
            (
                conv,
                max(known) - min(known) + 1 - len(known) if known else 0,
                *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                sum(p not in ("su", "ua", "au") for p in pairs),
                cost,
                audit,
                hashlib.sha256("\n".join(lines).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def conversations(n, longest, seed=1):
    chance = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", "u", None]
    texts = ["Yes.", "No!", "cut off", " ", "", "Why? \n", "ü.", "\x85", "Same.\x0b", None, "end.\x85"]
    out = []
    for conv in range(n):
        turn = 0
        for _ in range(chance.randint(1, longest)):
            text = chance.choice(texts) if chance.random() < 0.4 else f"Text {chance.randrange(10**6)}."
            out.append((conv, turn, chance.choice(roles), text))
            turn += chance.choice([1, 1, 1, 2, 5])
    return out


def checked(spark, rows, original=None):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = audited(frame, frame if original is None else spark.createDataFrame(original, SCHEMA))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(plain, original or rows)


def test_like_brute_force(spark):
    checked(spark, conversations(250, 9))


@pytest.mark.parametrize("spacing", [1, 2, 5])
def test_blocks(spark, monkeypatch, spacing):
    """Conversations over many checkpoints, cut by tasks too."""
    monkeypatch.setattr(turns, "LEAST_SPACING", spacing)
    monkeypatch.setattr(turns, "isqrt", lambda n: 0)
    checked(spark, conversations(25, 30, seed=spacing))


def test_one_long_conversation(spark):
    """Nearly all rows are one conversation; its blocks are no longer than the square root of it."""
    rows = [(7, t, r, x) for t, (_, _, r, x) in enumerate(conversations(1, 1, 3) * 300 + conversations(80, 20, 4))]
    rows += [(8, 0, "user", "Hi."), (8, 1, "assistant", "Ho.")]
    checked(spark, rows)
    found = repair(spark.createDataFrame(rows, SCHEMA))
    longest = max(len(r.codes) for r in found._blocks.collect())
    assert longest * longest <= max(len(rows), turns.LEAST_SPACING**2)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "x"), (1, 2, "user", "x")]
    got = repair(spark.createDataFrame(rows, SCHEMA)).repaired().orderBy("seq", "place").collect()
    assert [(r.edit, r.role, r.text) for r in got] == [("K", "system", "Be kind."), ("I", "user", ""), ("K", "assistant", "Hello.")]


def test_nulls_ties_and_repeated_rows(spark):
    rows = [
        (None, None, "user", "Hi."),
        (None, 3, None, "Text."),
        (None, 1, "assistant", None),
        (1, None, "user", "A."),
        (1, None, "assistant", "B."),
        (1, 5, "user", "A."),
        (1, 5, "user", "A."),
        (1, 5, "user", "C."),
        (2, None, "user", "A."),
    ]
    checked(spark, rows)


def test_no_rows(spark):
    checked(spark, [])
    checked(spark, [], original=[(3, 1, "user", "x"), (None, 1, "user", "x")])


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", "." * 500_000 + " " * 500_000), (1, 2, "user", " " * 500_000)]
    checked(spark, rows)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS seq", "2 AS block", "3 AS digest", "4 AS codes", "5 AS fault")
    assert audited(damaged(frame), frame).count() == 1


def test_damage(spark):
    rows = conversations(60, 9, seed=9) + [(None, None, None, None), (None, 4, "user", "A. b!"), (5, None, "user", "A.")]
    got = damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(damage(rows), key=repr)
