"""Lexicon category counts over texts.

A keyword counts where it stands between word boundaries of the lower-cased
text; word characters are letters, digits and underscore. A ``*`` stands for any
number of word characters; at the end it makes a stem, the usual case.

Three strategies with equal results:

``regex``  one alternation per category, run over the whole text. Exact for
           every keyword; cost grows with characters x keywords.
``token``  the text is split into words once, the words are reduced to the
           lexicon entries they match, and every category counts its own ones
           by hash lookup, so cost grows with words. Categories that hold
           phrases or punctuation use the alternation as well, but only on
           rows where such an entry occurs at all. No shuffle. The default.
``join``   (``lexicon_counts_join``) the texts' distinct words joined with the
           lexicon table, for lexicons of any length.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import word_count
from postloom.plans.scratch import scratch_path
from postloom.plans.sizing import broadcast_if_small

WORD_CHAR = r"[\p{L}\p{N}_]"
WORD_RUN = WORD_CHAR + "+"

STEM_MODES = ("match", "ignore")


@dataclass(frozen=True)
class Lexicon:
    """Category name -> keywords, and category name -> 1-based index."""

    categories: Mapping[str, Sequence[str]]
    indices: Mapping[str, int]

    @classmethod
    def from_dict(cls, categories: Mapping[str, Sequence[str]]) -> Lexicon:
        return cls(dict(categories), {name: i for i, name in enumerate(categories, start=1)})


def collect_lexicon(lexicon: DataFrame) -> Lexicon:
    """Bring a lexicon table to the driver, for the forms that write it into an expression.

    ``lexicon_counts_join`` takes the table as it is and suits long lexicons.
    """
    categories: dict[str, list[str]] = {}
    indices: dict[str, int] = {}
    for row in lexicon.orderBy("cat_idx", "entry").collect():
        words = categories.setdefault(row.cat_name, [])
        indices[row.cat_name] = row.cat_idx
        if row.keyword:
            words.append(row.keyword)
    return Lexicon(categories, indices)


def _is_word(text: str) -> bool:
    return text != "" and all(c.isalnum() or c == "_" for c in text)


def _is_stem(keyword: str) -> bool:
    return keyword.endswith("*") and len(keyword) > 1


def _used(keywords: Sequence[str], stems: str) -> list[str]:
    if stems not in STEM_MODES:
        raise ValueError(f"stems must be one of {STEM_MODES}")
    kept = keywords if stems == "match" else [k for k in keywords if "*" not in k]
    return list(dict.fromkeys(k for k in kept if k.strip("*")))


def _edges(keyword: str) -> tuple[str, str]:
    """Look-arounds that stand for a word boundary on either end."""
    first, last = (_is_word(c) or c == "*" for c in (keyword[0], keyword[-1]))
    left = rf"(?<!{WORD_CHAR})" if first else rf"(?<={WORD_CHAR})"
    right = rf"(?!{WORD_CHAR})" if last else rf"(?={WORD_CHAR})"
    return left, right


def _body(keyword: str) -> str:
    return f"{WORD_CHAR}*".join(map(re.escape, keyword.split("*")))


def lexicon_pattern(keywords: Sequence[str], stems: str = "match") -> str | None:
    """One alternation for a category, ``None`` when nothing is left to match."""
    parts = []
    for (left, right), run in groupby(_used(keywords, stems), key=_edges):
        parts.append(f"{left}(?:{'|'.join(map(_body, run))}){right}")
    return "|".join(parts) or None


def _in_set(item: str, words: Sequence[str]) -> str:
    """SQL membership test; Catalyst turns a long list into a hash set."""
    return f"{item} IN ({', '.join(f"'{w}'" for w in words)})" if words else "false"


def _entries_hit(keywords: Sequence[str]) -> str:
    """SQL for all entries, as spelled in the lexicon, that the words match."""
    lengths = sorted({len(k) - 1 for k in keywords if _is_stem(k)})
    member = _in_set("e", keywords)
    if not lengths:
        return f"filter(__words, e -> {member})"
    stems = ", ".join(f"if(length(w) >= {n}, left(w, {n}) || '*', NULL)" for n in lengths)
    return f"flatten(transform(__words, w -> filter(array(w, {stems}), e -> {member})))"


def _without_covered(keywords: Sequence[str]) -> list[str]:
    """Leave out entries that a stem of the list covers, so a word hits only one."""
    stems = {k[:-1] for k in keywords if _is_stem(k)}

    def covered(keyword: str) -> bool:
        word = keyword[:-1] if _is_stem(keyword) else keyword
        shorter = range(1, len(word) if _is_stem(keyword) else len(word) + 1)
        return any(word[:n] in stems for n in shorter)

    return [k for k in keywords if not covered(k)]


def _is_plain(keyword: str) -> bool:
    return _is_word(keyword[:-1] if _is_stem(keyword) else keyword)


def _check_names(df: DataFrame, names: Sequence[str]) -> None:
    taken = {c.lower() for c in df.columns}
    clash = sorted(n for n in names if n.lower() in taken)
    if clash or len({n.lower() for n in names}) < len(names):
        raise ValueError(f"Category names clash with each other or with columns: {clash}")


def _zero(text: str) -> Column:
    return F.when(F.col(text).isNotNull(), F.lit(0))


def _regex_counts(lexicon: Lexicon, stems: str) -> dict[str, Column]:
    counts = {}
    for name, keywords in lexicon.categories.items():
        pattern = lexicon_pattern(keywords, stems)
        counts[name] = (
            F.regexp_count(F.col("__text"), F.lit(pattern)) if pattern else _zero("__text")
        )
    return counts


def _token_counts(lexicon: Lexicon, stems: str) -> dict[str, Column]:
    counts = {}
    for name, keywords in lexicon.categories.items():
        used = _used(keywords, stems)
        plain = [k for k in used if _is_plain(k)]
        count = F.expr(f"array_size(filter(__hits, e -> {_in_set('e', _without_covered(plain))}))")
        other = [k for k in used if not _is_plain(k)]
        if other:
            count = F.when(
                F.col("__text").rlike(lexicon_pattern(other)),
                F.regexp_count(F.col("__text"), F.lit(lexicon_pattern(used))),
            ).otherwise(count)
        counts[name] = count if used else _zero("__text")
    return counts


def lexicon_counts(
    df: DataFrame,
    text_col: str,
    lexicon: Lexicon,
    strategy: str = "token",
    stems: str = "match",
    normalized: bool = False,
) -> DataFrame:
    """Add one count column per category.

    ``normalized=True`` divides by the word count (NULL for a text without
    words). NULL text gives NULL. ``stems="ignore"`` leaves out all entries
    with a ``*``.
    """
    names = list(lexicon.categories)
    _check_names(df, names)
    prepared = df.withColumn("__text", F.lower(F.col(text_col)))
    if strategy == "token":
        plain = dict.fromkeys(
            k for words in lexicon.categories.values() for k in _used(words, stems) if _is_plain(k)
        )
        prepared = prepared.withColumn(
            "__words", F.regexp_extract_all("__text", F.lit(WORD_RUN), F.lit(0))
        ).withColumn("__hits", F.expr(_entries_hit(list(plain))))
        counts = _token_counts(lexicon, stems)
    elif strategy == "regex":
        counts = _regex_counts(lexicon, stems)
    else:
        raise ValueError("strategy must be 'token' or 'regex'")
    if normalized:
        prepared = prepared.withColumn("__n", F.nullif(word_count("__text"), F.lit(0)))
        counts = {name: count / F.col("__n") for name, count in counts.items()}
    return prepared.select(*df.columns, *[counts[n].alias(n) for n in names])


def lexicon_features(
    df: DataFrame,
    text_col: str,
    lexicon: Lexicon,
    normalized: bool = False,
    **options: str,
) -> DataFrame:
    """Feature table: input columns without the text, word count, categories.

    ``wordCount`` is added only to raw counts.
    """
    base = df if normalized else df.withColumn("wordCount", word_count(text_col))
    return lexicon_counts(base, text_col, lexicon, normalized=normalized, **options).drop(text_col)


def lexicon_vector(
    df: DataFrame,
    text_col: str,
    lexicon: Lexicon,
    normalized: bool = False,
    output_col: str = "lexicon_vector",
    **options: str,
) -> DataFrame:
    """Add the counts as one array: category ``i`` at position ``i - 1``, gaps 0."""
    by_index = {lexicon.indices[n]: n for n, words in lexicon.categories.items() if words}
    renamed = Lexicon(
        {f"__c{i}": lexicon.categories[n] for i, n in by_index.items()},
        {f"__c{i}": i for i in by_index},
    )
    zero = F.lit(0.0 if normalized else 0)
    items = [
        F.col(f"__c{i}") if i in by_index else zero for i in range(1, max(by_index, default=0) + 1)
    ]
    counted = lexicon_counts(df, text_col, renamed, normalized=normalized, **options)
    vector = F.when(F.col(text_col).isNotNull(), F.array(*items))
    return counted.select(*df.columns, vector.alias(output_col))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SPECIAL = r"([\\.\[\]{}()^$|?+-])"


def _entries(lexicon: DataFrame, stems: str) -> DataFrame:
    """``cat_idx, keyword, entry, plain, pattern, anchor`` of the entries in use.

    The anchor of an entry that is no single word or stem is a token that every match
    holds: a whole word, a mark, or the beginning (``x*``) or end (``*x``) of a word.
    """
    if stems not in STEM_MODES:
        raise ValueError(f"stems must be one of {STEM_MODES}")
    used = lexicon.where(F.col("keyword").isNotNull() & (F.translate("keyword", "*", "") != ""))
    if stems == "ignore":
        used = used.where(~F.col("keyword").contains("*"))
    order = F.col("entry") if "entry" in lexicon.columns else F.monotonically_increasing_id()
    key = F.col("keyword")
    first, last = F.left(key, F.lit(1)), F.right(key, F.lit(1))
    is_word = lambda c: c.rlike(rf"^(?:{WORD_CHAR}|\*)$")
    left = F.when(is_word(first), rf"(?<!{WORD_CHAR})").otherwise(rf"(?<={WORD_CHAR})")
    right = F.when(is_word(last), rf"(?!{WORD_CHAR})").otherwise(rf"(?={WORD_CHAR})")
    literal = F.regexp_replace(key, _SPECIAL, r"\\$1")
    body = F.replace(literal, F.lit("*"), F.lit(f"{WORD_CHAR}*"))
    found = lambda pattern: F.nullif(F.regexp_extract(key, pattern, 0), F.lit(""))
    anchor = F.coalesce(
        found(rf"(?<![\p{{L}}\p{{N}}_*]){WORD_RUN}(?![\p{{L}}\p{{N}}_*])"),
        found(r"[^\p{L}\p{N}_*\s]"),
        found(rf"(?<![\p{{L}}\p{{N}}_*]){WORD_RUN}\*"),
        found(rf"\*{WORD_RUN}(?![\p{{L}}\p{{N}}_*])"),
        F.raise_error(F.concat(F.lit("No word of this entry has a known beginning or end: "), key)).cast("string"),
    )
    plain = key.rlike(rf"^{WORD_RUN}\*?$")
    return used.groupBy("cat_idx", "keyword").agg(F.min(order).alias("entry")).select(
        "cat_idx",
        "keyword",
        "entry",
        plain.alias("plain"),
        F.concat(left, F.lit("(?:"), body, F.lit(")"), right).alias("pattern"),
        F.when(plain, key).otherwise(anchor).alias("anchor"),
    )


def _tokens_with_entries(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """Each distinct token with the entries that it matches or anchors."""
    ends = entries.agg(
        F.collect_set(F.when(F.col("anchor").endswith("*"), F.length("anchor") - 1)).alias("heads"),
        F.collect_set(F.when(F.col("anchor").startswith("*"), F.length("anchor") - 1)).alias("tails"),
    ).first()
    word = F.col("token")
    forms = [word]
    forms += [F.when(F.length(word) >= n, F.concat(F.left(word, F.lit(n)), F.lit("*"))) for n in ends["heads"]]
    forms += [F.when(F.length(word) >= n, F.concat(F.lit("*"), F.right(word, F.lit(n)))) for n in ends["tails"]]
    every = tokens.select("token").distinct().select("token", F.explode(F.array_distinct(F.array(*forms))).alias("anchor"))
    return every.join(broadcast_if_small(entries), "anchor").drop("anchor")


#: Entries of a category with phrases or marks, at most, that make one alternation over every text.
MAX_ALTERNATION = 200

#: Positions, from 1, in a sorted array at which another token begins, and each token with its count.
_FIRSTS = "filter(sequence(1, greatest(size(__sorted), 1)), p -> p = 1 OR get(__sorted, p - 1) <> get(__sorted, p - 2))"
_COUNTED = (
    "if(size(__sorted) > 0, "
    "transform(__firsts, (p, i) -> struct(get(__sorted, p - 1) AS token, "
    "CAST(coalesce(get(__firsts, i + 1), size(__sorted) + 1) - p AS BIGINT) AS n)), NULL)"
)


def lexicon_counts_join(
    df: DataFrame,
    text_col: str,
    lexicon: DataFrame,
    keys: Sequence[str],
    stems: str = "match",
) -> DataFrame:
    """Counts per row and category through a join with the lexicon table.

    The result holds ``keys`` and one column per category, one row for each input
    row, whether or not ``keys`` identify it. The lexicon may have any length and
    any entries, phrases and punctuation included, and counts as in ``lexicon_counts``.

    Rows are reduced to their distinct words with counts once, each where it stands, by its sorted
    words. The distinct tokens of all texts meet the lexicon, and a token then brings its categories
    back to the rows, by broadcast if a count shows those tokens to be few, so that only a row's sums
    are shuffled; otherwise the adaptive skew join splits a token that fills much of all texts. A
    category of up to ``MAX_ALTERNATION`` entries that has entries of several words or marks is
    counted by its alternation as the row is read. Of longer ones, rows with a token that such an
    entry needs are counted by the alternation of just the entries that may occur in them; the
    texts are written for that.
    """
    entries = _written(_entries(lexicon, stems), "entries")
    category_rows = lexicon.select("cat_idx", "cat_name").distinct().orderBy("cat_idx").collect()
    short = _alternations(entries)
    if short:
        entries = entries.where(F.col("plain") | ~F.col("cat_idx").isin(list(short)))
    has_odd = not entries.where(~F.col("plain")).isEmpty()

    rows = df.select(
        F.monotonically_increasing_id().alias("__row"), *keys, F.lower(F.col(text_col)).alias("__text")
    )
    if has_odd:
        rows = _written(rows, "texts")
    token = rf"{WORD_RUN}|[^\p{{L}}\p{{N}}_\s]" if has_odd else WORD_RUN
    sorted_tokens = F.array_sort(F.regexp_extract_all("__text", F.lit(token), F.lit(0))).alias("__sorted")
    text = F.col("__text")
    odd = [
        F.when(text.rlike(some), F.regexp_count(text, F.lit(every)).cast("long")).alias(f"__odd{i}")
        for i, (some, every) in short.items()
    ]
    counted_rows = _written(
        rows.select("__row", *keys, text.isNotNull().alias("__has_text"), *odd, sorted_tokens)
        .withColumn("__firsts", F.expr(_FIRSTS))
        .withColumn("__counted", F.expr(_COUNTED))
        .drop("__sorted", "__firsts"),
        "tokens",
    )
    tokens = counted_rows.select("__row", F.inline("__counted").alias("token", "n"))
    known = _written(_tokens_with_entries(tokens, entries), "known")
    # a word hits a category once, by however many entries; written, so that the join can split a hot word
    plain = _written(known.where("plain").groupBy("token").agg(F.collect_set("cat_idx").alias("cats")), "plain")
    hits = tokens.join(broadcast_if_small(plain), "token").select(
        "__row", F.explode("cats").alias("cat_idx"), "n", F.lit(False).alias("odd")
    )
    if has_odd:
        hits = hits.unionByName(_odd_counts(rows, tokens, known))
    per_cat = [
        F.coalesce(
            F.max(F.when(F.col("odd") & (F.col("cat_idx") == r.cat_idx), F.col("n"))),
            F.sum(F.when(~F.col("odd") & (F.col("cat_idx") == r.cat_idx), F.col("n"))),
        ).alias(r.cat_name)
        for r in category_rows
    ]
    counted = hits.groupBy("__row").agg(*per_cat)

    def count(cat_idx: int, name: str) -> Column:
        own = [F.col(f"__odd{cat_idx}")] if cat_idx in short else []
        return F.when(F.col("__has_text"), F.coalesce(*own, F.col(f"`{name}`"), F.lit(0))).alias(name)

    return (
        counted_rows.drop("__counted")
        .join(counted, "__row", "left")
        .select(*keys, *[count(r.cat_idx, r.cat_name) for r in category_rows])
    )


def _alternations(entries: DataFrame) -> dict[int, tuple[str, str]]:
    """For each short category with entries of several words or marks the patterns of those, and of all."""
    odd = (
        entries.groupBy("cat_idx")
        .agg(F.count(F.lit(1)).alias("size"), F.bool_or(~F.col("plain")).alias("odd"))
        .where(F.col("odd") & (F.col("size") <= MAX_ALTERNATION))
    )
    found: dict[int, list] = {}
    for row in entries.join(odd, "cat_idx", "left_semi").orderBy("cat_idx", "entry", "keyword").collect():
        found.setdefault(row.cat_idx, []).append(row)
    return {
        i: ("|".join(r.pattern for r in own if not r.plain), "|".join(r.pattern for r in own)) for i, own in found.items()
    }


def _odd_counts(rows: DataFrame, tokens: DataFrame, known: DataFrame) -> DataFrame:
    """Counts of the (row, category) pairs in which an entry of several words or marks occurs."""
    odd = known.where(~F.col("plain")).select("token", "cat_idx", "pattern")
    text = F.col("__text")
    patterns = F.array_join(F.array_sort(F.collect_set("pattern")), "|")
    perhaps = tokens.select("__row", "token").join(broadcast_if_small(odd), "token").groupBy("__row", "cat_idx").agg(patterns.alias("any"))
    occurs = (
        perhaps.join(rows.select("__row", "__text"), "__row").where(F.regexp_like(text, F.col("any"))).select("__row", "cat_idx", "__text")
    )
    entry = F.struct("entry", "keyword", "pattern").alias("e")
    candidates = (
        occurs.join(tokens.select("__row", "token"), "__row")
        .join(broadcast_if_small(known.select("token", "cat_idx", entry)), ["token", "cat_idx"])
        .groupBy("__row", "cat_idx")
        .agg(F.any_value("__text").alias("__text"), F.array_sort(F.collect_set("e")).alias("entries"))
    )
    pattern = F.array_join(F.col("entries.pattern"), "|")
    return candidates.select(
        "__row", "cat_idx", F.regexp_count(text, pattern).cast("long").alias("n"), F.lit(True).alias("odd")
    )
