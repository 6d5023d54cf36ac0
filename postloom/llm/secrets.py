"""Secret scans with character Markov models, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import stage
from postloom.llm.spans import SPAN, clean_text, count_kind, joined, labelled, let, matches, overlaps

# The patterns of the base spans.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that starts with AKIA, 20 characters or more; shorter runs would be dropped.
ACCESS = r"AKIA[A-Z0-9]{16,}"
#: Whole runs of 24 characters or more; shorter runs would be dropped.
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")
MIN_VALUE = 6

#: Candidate strings of the models.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Candidates that are ordinary identifiers for sure: one kind of characters, or words joined by one.
ORDINARY = r"^([A-Za-z]+|[0-9]+|[a-z]+([_/=+-][a-z]+)+)$"
#: The same with possessive runs, which Java matches without recursion, however long they are.
ORDINARY_RUNS = r"^(?:[A-Za-z]++|[0-9]++|[a-z]++(?:[_/=+-][a-z]++)++)$"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Transitions that a character's own share of all counts as, beside those counted after another.
BACK_OFF = 10
#: Log-likelihood ratios are kept as whole thousandths, so that sums are exact.
SCALE = 1000
#: A candidate is random if its mean ratio per transition is at least this.
MIN_RATIO = 0.5


def _raw(text: Column) -> list[Column]:
    """Base matches of each kind and the candidates, in one reading of the text."""
    assign = F.filter(
        matches(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= MIN_VALUE
    )
    return [
        assign.alias("assign"),
        matches(text, ACCESS).alias("access"),
        matches(text, HEX).alias("hex"),
        matches(text, CANDIDATE).alias("candidates"),
    ]


def _transitions(samples: DataFrame) -> DataFrame:
    """``secret, a, b``: neighbouring characters as positions in the alphabet."""
    pairs = samples.select("secret", F.split("sample", "").alias("chars")).select(
        "secret",
        F.explode(
            F.transform(
                F.filter(F.arrays_zip(F.col("chars").alias("a"), F.slice("chars", F.lit(2), F.size("chars")).alias("b")),
                         lambda p: p["b"].isNotNull() & (p["b"] != "")),
                lambda p: F.struct(F.instr(F.lit(ALPHABET), p["a"]).alias("a"), F.instr(F.lit(ALPHABET), p["b"]).alias("b")),
            )
        ).alias("p"),
    )
    return pairs.select("secret", "p.a", "p.b").where("a > 0 AND b > 0")


def train_ratio(samples: DataFrame) -> list[int] | None:
    """Log-likelihood ratios of all transitions, in thousandths, from ``sample, secret``.

    Two first-order Markov models over ``ALPHABET`` are counted over all
    samples and backed off to how common a character is; the result has one entry per pair of characters. Null without samples
    of both labels.
    """
    k = len(ALPHABET)
    counts = {True: [[0] * (k + 1) for _ in range(k + 1)], False: [[0] * (k + 1) for _ in range(k + 1)]}
    for r in _transitions(samples).groupBy("secret", "a", "b").count().collect():  # 2 * 67 * 67 rows at most
        counts[r["secret"]][r["a"]][r["b"]] = r["count"]
    if not all(any(map(any, c)) for c in counts.values()):
        return None

    shares = {}
    for label, rows in counts.items():
        total = sum(map(sum, rows))
        shares[label] = [(sum(row[b] for row in rows) + 1) / (total + k) for b in range(k + 1)]

    def probability(label: bool, a: int, b: int) -> float:
        row = counts[label][a]
        return (row[b] + BACK_OFF * shares[label][b]) / (sum(row) + BACK_OFF)

    return [
        round(SCALE * math.log(probability(True, a, b) / probability(False, a, b)))
        for a in range(1, k + 1)
        for b in range(1, k + 1)
    ]


def ratio(value: Column, table: list[int]) -> Column:
    """Sum of a string's log-likelihood ratios, in thousandths."""
    k = len(ALPHABET)
    entries = F.lit(table).cast("array<int>")

    def of(codes: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 2),
            F.lit(0).cast("long"),
            lambda acc, i: acc + F.get(entries, (F.get(codes, i) - 1) * k + F.get(codes, i + 1) - 1),
        )

    codes = F.transform(
        F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c)
    )
    return let(codes, of)


def find_secrets(
    docs: DataFrame,
    samples: DataFrame | None = None,
    min_ratio: float = MIN_RATIO,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Spans that hold secrets: the base patterns, and random strings by two Markov models.

    ``samples`` (``sample string, secret boolean``) trains the models. Without it
    the labelled samples are the values of all base spans against the candidates
    outside of them that are ordinary identifiers (``ORDINARY``). A candidate (``CANDIDATE``) outside base
    spans becomes a ``random`` span when its log-likelihood ratio per transition is at
    least ``min_ratio``. Without samples of both labels nothing is added.

    Result per row: ``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans``.
    Null and empty texts have no spans (the hash of an empty string); repeated
    rows and null ids give their own rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), clean_text(text_col).alias("text"))
    raw = stage(rows.select("doc_id", *_raw(F.col("text"))), "secrets")
    base = F.array_sort(F.concat(*(labelled(F.col(k), k, i) for i, k in enumerate(KINDS))))
    values = F.concat(
        F.transform("assign", lambda s: F.regexp_extract(s["value"], ASSIGN, 2)),
        F.col("access.value"),
        F.col("hex.value"),
    )
    found = raw.select("doc_id", base.alias("base"), "candidates", values.alias("secrets")).select(
        "doc_id",
        "base",
        F.filter("candidates", lambda c: ~overlaps(c, F.col("base"))).alias("candidates"),
        "secrets",
    )
    if samples is None:
        labelled_secret = found.select(F.explode("secrets").alias("sample"), F.lit(True).alias("secret"))
        ordinary = (
            found.select(F.explode("candidates.value").alias("sample"), F.lit(False).alias("secret"))
            .where(F.col("sample").rlike(ORDINARY_RUNS))
        )
        samples = labelled_secret.unionByName(ordinary)
    table = train_ratio(samples.where("sample IS NOT NULL AND secret IS NOT NULL"))
    if table is None:
        random = F.expr(f"CAST(array() AS {SPAN})")
    else:
        random = F.filter(
            F.col("candidates"),
            lambda c: ratio(c["value"], table) >= F.lit(min_ratio * SCALE) * (F.length(c["value"]) - 1),
        )
    every = found.select(
        "doc_id", "base", F.array_sort(F.concat("base", labelled(random, "random", len(KINDS)))).alias("every")
    )
    return every.select(
        "doc_id",
        *(count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS),
        count_kind(F.col("every"), "random").alias("n_random"),
        F.sha2(F.encode(joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        joined(F.col("every")).alias("spans"),
    )
