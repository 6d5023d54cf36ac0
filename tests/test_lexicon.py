import random
import re

import pytest

from postloom.operators import (
    Lexicon,
    collect_lexicon,
    lexicon_composites,
    lexicon_counts,
    lexicon_counts_join,
    lexicon_features,
    lexicon_pattern,
    lexicon_vector,
)
from postloom.schemas import COMPOSITES, LEXICON as LEXICON_SCHEMA
from postloom.sources import read_lexicon

CATEGORIES = {
    "affect": ["happy", "happi*", "sad", "cry*"],
    "words": ["kind", "kind of", "of", "don't", "a.b"],
    "stems": ["zz*", "un*"],
    "marks": [":)", "c++", "(like)"],
    "empty": [],
    "unicode": ["été", "naïve*", "straße", "ça"],
    "wildcard": ["*ing", "un*y", "*", "f**t"],
    "order": ["kind of", "kind", "of", "i", "i'm"],
}
TEXTS = [
    "A happy dog met one sad cat by the lake.",
    "HAPPY happiness unhappy happi cry crying. Sad-sad sad_sad sad2",
    "kind of kind of of kind; kindof kind  of",
    "don't dont don t I'm i'm",
    "a.b axb a.b.b x:)y :) c++x c++ x(like)y (like)",
    "été ÉTÉ naïvement straße STRASSE ça, ça! ça café",
    "unzz un zz zzz ²un un²",
    "",
    "  ... !!! ",
    None,
]


def _brute_count(text, keywords, stems):
    """Scan with Python's own Unicode-aware boundaries."""
    if text is None:
        return None
    alternatives = []
    for keyword in keywords:
        if "*" in keyword:
            if stems == "match":
                if keyword != "*":
                    parts = map(re.escape, keyword.split("*"))
                    alternatives.append(r"\b" + r"\w*".join(parts) + r"\b")
        else:
            alternatives.append(r"\b" + re.escape(keyword) + r"\b")
    if not alternatives:
        return 0
    return len(re.findall("|".join(alternatives), text.lower()))


def _frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


@pytest.mark.parametrize("stems", ["match", "ignore"])
@pytest.mark.parametrize("strategy", ["regex", "token"])
def test_counts_equal_brute_force(spark, strategy, stems):
    lexicon = Lexicon.from_dict(CATEGORIES)
    out = lexicon_counts(_frame(spark), "text", lexicon, strategy=strategy, stems=stems)
    for row in out.collect():
        for name, keywords in CATEGORIES.items():
            expected = _brute_count(TEXTS[row.id], keywords, stems)
            assert row[name] == expected, (TEXTS[row.id], name)


def test_counts_equal_brute_force_on_random_texts(spark):
    rng = random.Random(7)
    pieces = [
        "kind", "of", "kindof", "happy", "happi", "happier", "sad", " ", " ", " ", ".", "'", "_",
        "3", "é", "été", "don't", "i", "i'm", "cry", "zz", "un", "-", "\n", ":)", "c++", "a.b",
    ]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 60))) for _ in range(300)]
    lexicon = Lexicon.from_dict(CATEGORIES)
    df = _frame(spark, texts).repartition(3)
    for strategy in ("regex", "token"):
        for row in lexicon_counts(df, "text", lexicon, strategy=strategy).collect():
            for name, keywords in CATEGORIES.items():
                assert row[name] == _brute_count(texts[row.id], keywords, "match"), texts[row.id]


def _table(spark, categories):
    rows = [
        (i, name, word, "*" in word, j)
        for i, (name, words) in enumerate(categories.items(), start=1)
        for j, word in enumerate(words)
    ]
    rows += [(90, "none", None, None, None)]
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


@pytest.mark.parametrize("stems", ["match", "ignore"])
def test_join_equals_token_strategy(spark, stems):
    plain = {
        "affect": ["happy", "happi*", "happiness", "sad", "cry*"],
        "overlap": ["un*", "unzz", "un", "u*"],
        "unicode": ["été", "naïve*", "straße"],
    }
    joined = lexicon_counts_join(_frame(spark), "text", _table(spark, plain), ["id"], stems=stems)
    direct = lexicon_counts(
        _frame(spark), "text", Lexicon.from_dict(plain | {"none": []}), stems=stems
    ).drop("text")
    assert joined.columns == direct.columns
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, direct.collect()))


@pytest.mark.parametrize("stems", ["match", "ignore"])
def test_join_counts_phrases_and_marks(spark, stems):
    joined = lexicon_counts_join(_frame(spark), "text", _table(spark, CATEGORIES), ["id"], stems=stems)
    for row in joined.collect():
        for name, keywords in CATEGORIES.items():
            if keywords:
                assert row[name] == _brute_count(TEXTS[row.id], keywords, stems), (row.id, name)


def test_join_names_an_entry_without_any_edge(spark):
    with pytest.raises(Exception, match="No word of this entry"):
        lexicon_counts_join(_frame(spark), "text", _table(spark, {"x": ["*a*"]}), ["id"]).collect()


def test_join_keeps_rows_with_equal_keys_apart(spark):
    df = spark.createDataFrame([(1, "sad"), (1, "sad sad"), (1, None), (2, "")], "id int, text string")
    out = lexicon_counts_join(df, "text", _table(spark, {"x": ["sad"], "y": ["so sad"]}), ["id"])
    assert sorted(((r.id, r.x) for r in out.collect()), key=str) == [(1, 1), (1, 2), (1, None), (2, 0)]


def test_join_takes_a_very_long_lexicon(spark):
    words = spark.range(300_000).selectExpr(
        "1 AS cat_idx", "'x' AS cat_name", "concat('w', id) AS keyword", "false AS is_stem", "id AS entry"
    )
    phrase = spark.createDataFrame([(1, "x", "w1 w2", False, 300_000)], words.schema)
    df = spark.createDataFrame([(1, "w1 w2 w299999 w300000"), (2, "w1  w2")], "id int, text string")
    out = lexicon_counts_join(df, "text", words.unionByName(phrase), ["id"])
    # the single word stands first in the lexicon, so it wins over the phrase
    assert {r.id: r.x for r in out.collect()} == {1: 3, 2: 2}


def test_join_accepts_a_lexicon_without_stems(spark):
    out = lexicon_counts_join(_frame(spark), "text", _table(spark, {"x": ["sad"]}), ["id"])
    assert {r.id: r.x for r in out.collect()}[0] == 1


def test_normalized_is_raw_over_word_count(spark):
    lexicon = Lexicon.from_dict(CATEGORIES)
    raw = {r.id: r for r in lexicon_features(_frame(spark), "text", lexicon).collect()}
    out = lexicon_features(_frame(spark), "text", lexicon, normalized=True)
    assert "wordCount" not in out.columns
    for row in out.collect():
        for name in CATEGORIES:
            count, words = raw[row.id][name], raw[row.id].wordCount
            if not words:
                assert row[name] is None
            else:
                assert row[name] == pytest.approx(count / words)
                assert row[name] <= count


def test_feature_table_layout(spark):
    lexicon = Lexicon.from_dict(CATEGORIES)
    out = lexicon_features(_frame(spark), "text", lexicon)
    assert out.columns == ["id", "wordCount", *CATEGORIES]
    assert out.count() == len(TEXTS)
    words = {r.id: r.wordCount for r in out.collect()}
    assert words[0] == 11 and words[7] == 0 and words[8] == 6 and words[9] is None


def test_empty_frame(spark):
    lexicon = Lexicon.from_dict(CATEGORIES)
    out = lexicon_features(_frame(spark).limit(0), "text", lexicon)
    assert out.count() == 0 and out.columns == ["id", "wordCount", *CATEGORIES]


def test_vector_positions(spark):
    lexicon = Lexicon({"b": ["sad"], "a": ["happy"], "none": []}, {"b": 4, "a": 2, "none": 9})
    df = _frame(spark)
    rows = {r.id: r.lexicon_vector for r in lexicon_vector(df, "text", lexicon).collect()}
    assert rows[0] == [0, 1, 0, 1]
    assert rows[9] is None
    norm = lexicon_vector(df, "text", lexicon, normalized=True).where("id = 0").first()
    assert sum(norm.lexicon_vector) < sum(rows[0])


def test_names_must_not_clash(spark):
    with pytest.raises(ValueError, match="clash"):
        lexicon_counts(_frame(spark), "text", Lexicon.from_dict({"ID": ["x"]}))
    with pytest.raises(ValueError, match="clash"):
        lexicon_counts(_frame(spark), "text", Lexicon.from_dict({"a": ["x"], "A": ["y"]}))


def test_bad_options(spark):
    lexicon = Lexicon.from_dict({"a": ["x"]})
    with pytest.raises(ValueError, match="strategy"):
        lexicon_counts(_frame(spark), "text", lexicon, strategy="other")
    with pytest.raises(ValueError, match="stems"):
        lexicon_counts(_frame(spark), "text", lexicon, stems="other")


def test_pattern_of_stems_only():
    assert lexicon_pattern(["zz*"], stems="ignore") is None
    assert lexicon_pattern([]) is None


def test_lexicon_from_files(spark, tmp_path):
    (tmp_path / "map.txt").write_text("2\taffect\n4\twords\n7\tempty\n")
    (tmp_path / "dict.txt").write_text("happy\t2\nhappi*\t2\nkind of\t4\t2\nof\t4\n")
    table = read_lexicon(spark, str(tmp_path / "map.txt"), str(tmp_path / "dict.txt"))
    lexicon = collect_lexicon(table)
    assert lexicon.categories == {
        "affect": ["happy", "happi*", "kind of"], "words": ["kind of", "of"], "empty": [],
    }
    assert lexicon.indices == {"affect": 2, "words": 4, "empty": 7}


def test_tokens_are_split_once_and_long_lists_are_hashed(spark):
    lexicon = Lexicon.from_dict({"a": [f"w{i}" for i in range(30)], "b": ["x"], "c": ["y"]})
    plan = lexicon_counts(_frame(spark), "text", lexicon)._jdf.queryExecution()
    text = plan.optimizedPlan().toString()
    assert text.count("regexp_extract_all") == 1
    assert "INSET" in text
    assert "Exchange" not in plan.executedPlan().toString()


def test_composites(spark):
    names = sorted({c for cols in COMPOSITES.values() for c in cols})
    df = spark.createDataFrame(
        [tuple(range(1, len(names) + 1)), (None, *range(2, len(names) + 1))],
        ", ".join(f"`{n}` int" for n in names),
    )
    full, partial = lexicon_composites(df).collect()
    value = dict(zip(names, range(1, len(names) + 1)))
    for name, cols in COMPOSITES.items():
        assert full[name] == sum(value[c] for c in cols)
        assert (partial[name] is None) == (names[0] in cols)


def test_composites_name_missing_columns(spark):
    df = spark.createDataFrame([(1,)], "affect int")
    with pytest.raises(ValueError, match="cogmech"):
        lexicon_composites(df)
    out = lexicon_composites(df, {"twice": ["affect", "affect"]})
    assert out.first().twice == 2


def test_words_of_a_row_are_counted_without_a_shuffle(spark, monkeypatch):
    import importlib

    module = importlib.import_module("postloom.operators.lexicon")
    plans, real = {}, module._written
    monkeypatch.setattr(
        module, "_written", lambda df, name: plans.update({name: df._jdf.queryExecution().toString()}) or real(df, name)
    )
    texts = spark.createDataFrame([(1, "b a b a. b"), (1, ""), (2, None), (3, "a")], "id int, text string")
    table = spark.createDataFrame([(1, "x", "b", False, 0), (2, "y", "a b", False, 0), (2, "y", "a", False, 1)],
                                  "cat_idx int, cat_name string, keyword string, is_stem boolean, entry long")
    got = module.lexicon_counts_join(texts, "text", table, ["id"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 0, 0), (1, 3, 2), (2, None, None), (3, 0, 1)]
    assert "Exchange" not in plans["tokens"]


def test_join_writes_one_row_for_each_text_and_no_text(spark, monkeypatch):
    import importlib

    module = importlib.import_module("postloom.operators.lexicon")
    written, real = {}, module._written
    monkeypatch.setattr(module, "_written", lambda df, name: written.setdefault(name, real(df, name)))
    got = lexicon_counts_join(_frame(spark), "text", _table(spark, CATEGORIES), ["id"])
    assert got.count() == len(TEXTS)
    assert "texts" not in written
    assert written["tokens"].count() == len(TEXTS)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # what is shuffled by row are sums, not words
    assert plan.count("Generate") == 2 and "Join Inner, (__row" not in plan


@pytest.mark.parametrize("most", [0, 200])
def test_join_counts_phrases_of_short_and_long_categories(spark, monkeypatch, most):
    import importlib

    monkeypatch.setattr(importlib.import_module("postloom.operators.lexicon"), "MAX_ALTERNATION", most)
    rng = random.Random(9)
    pieces = ["kind", "of", "kindof", "happy", "happier", "sad", " ", " ", " ", ".", "'", "_", "3", "é", "i'm", "un", ":)", "c++"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(150)] + [None]
    out = lexicon_counts_join(_frame(spark, texts), "text", _table(spark, CATEGORIES), ["id"]).collect()
    assert len(out) == len(texts)
    for row in out:
        for name, keywords in CATEGORIES.items():
            if keywords:
                assert row[name] == (None if texts[row.id] is None else _brute_count(texts[row.id], keywords, "match"))
