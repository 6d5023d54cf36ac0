"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import attach, stage
from postloom.llm.spans import (
    clean_text,
    count_kind,
    joined,
    matches,
    odd,
    overlaps,
    placed_pieces,
    replaced,
)

# The patterns of the base spans. Possessive runs and a start at
# the beginning of a run find the same matches in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A run of 12 digits or more; shorter runs would be dropped.
CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

TERM = r"[\p{L}\p{N}]{3,}"
#: Different texts that must hold both a term and an entity.
SUPPORT = 3
#: Shares of an entity's information above which a term is generalised, and removed.
GENERALISE = 0.5
REMOVE = 0.8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(
        digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _part(value: Column) -> Column:
    return F.regexp_replace(value, "^0+(?=.)", "")


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(_part(p)) <= 3) & (_part(p).try_cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _mentions(placed: Column, kind: str, order: int) -> Column:
    """Valid matches as labelled spans, with the entity that each names."""
    spans = F.transform(
        odd(placed),
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(order).alias("order"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            F.lower(s["value"]).alias("entity"),
        ),
    )
    return F.filter(spans, lambda m: _valid(kind, m["entity"]))


def _free_terms(text: Column, base: Column) -> Column:
    """Words of the whole text that touch no base span."""
    return F.filter(matches(text, TERM), lambda t: ~overlaps(t, base))


def _can_disclose(n: int, generalise: float) -> Column:
    """Whether a term and an entity with these numbers of documents could reach the share at all.

    A necessary condition: the share is at most ln(n / n_term) / ln(n / n_entity) where the term is the more frequent.
    """
    total = F.lit(float(n))
    reach = F.ln(total / F.col("n_term")) >= generalise * F.ln(total / F.col("n_entity")) - 1e-9
    return (F.col("n_term") <= F.col("n_entity")) | reach


def _disclosing(pairs: DataFrame, n: int, support: int, generalise: float) -> DataFrame:
    """``entity, term, share, n_both`` of the terms that disclose more than a share of an entity's information.

    The share is the pointwise mutual information of term and entity over the
    information of the entity, from numbers of documents.
    """
    counted = (
        pairs.groupBy("entity", "n_entity", "term", "n_term")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("weight").alias("n_both"))
        .where(F.col("texts") >= support)
    )
    total = F.lit(float(n))
    information = F.ln(total / F.col("n_entity"))
    both = F.least("n_both", "n_entity", "n_term").cast("double")
    mutual = F.ln(both * total / (F.col("n_entity").cast("double") * F.col("n_term").cast("double")))
    share = F.when(information > 0, mutual / information).otherwise(F.lit(0.0))
    return counted.select("entity", "term", "n_both", share.alias("share")).where(F.col("share") >= generalise)


def find_private(
    docs: DataFrame,
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Spans of personal data, and of the terms that would reveal it.

    The base patterns give the protected entities (lower-cased values). A term is
    a word anywhere in a document that touches no base span. Over all documents the
    share that a term discloses is PMI(term; entity) / IC(entity), from the numbers
    of documents that hold the word, the entity and both. Terms that share at least
    ``support`` different texts with one entity (copies are one text) and
    disclose ``remove`` or more become spans of kind ``remove``, else of ``generalise`` or
    more, of kind ``generalise``, wherever they stand in the documents with that entity.

    Result per row: ``doc_id, n_email, n_ip, n_card, n_phone, n_terms, base_sha256,
    spans``, and ``found``, the labelled spans that ``sanitised`` takes.
    Null and empty texts have no spans; repeated rows and null ids give their own
    rows; other columns are ignored; an empty table gives an empty result. A text of
    any length is read whole; its copies are looked at once.
    """
    text = F.col("text")
    plain = docs.select(F.col(id_col).alias("doc_id"), clean_text(text_col).alias("text"))
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
    mentions = F.concat(
        *(_mentions(placed_pieces(text, patterns[k]), k, i) for i, k in enumerate(KINDS))
    )
    row = F.monotonically_increasing_id()
    has = F.size("mentions") > 0
    rows = stage(
        plain.select("doc_id", "text", mentions.alias("mentions"), row.alias("row")).select(
            "doc_id",
            "row",
            F.array_sort(F.transform("mentions", lambda m: m.dropFields("entity"))).alias("base"),
            F.array_distinct(F.transform("mentions", lambda m: F.concat_ws(":", m["kind"], m["entity"]))).alias("entities"),
            F.when(has, F.col("text")).alias("text"),
            F.when(has, F.unhex(F.md5(F.encode("text", "UTF-8")))).alias("copy"),
        ),
        "mentions",
    )
    n = rows.count()
    own = rows.select("doc_id", "row", "base")
    named = rows.where("copy IS NOT NULL")
    texts = stage(
        named.groupBy("copy").agg(
            F.any_value("text").alias("text"),
            F.any_value("base").alias("base"),
            F.any_value("entities").alias("entities"),
            F.count(F.lit(1)).alias("weight"),
        ),
        "texts",
    )
    entities = texts.select("copy", "weight", F.explode("entities").alias("entity"))
    # an entity of fewer different texts cannot have a term with enough of them
    shared = (
        entities.groupBy("entity")
        .agg(F.sum("weight").alias("n_entity"), F.count(F.lit(1)).alias("n_texts"))
        .where(F.col("n_texts") >= support)
    )
    kept = stage(attach(entities, shared, ["entity"], "n_texts", max(1, n)).drop("n_texts"), "kept")
    words = stage(
        plain.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("term"))
        .where(F.length("term") >= 3)
        .groupBy(F.xxhash64("term").alias("word"))
        .agg(F.count(F.lit(1)).alias("n_term"))
        .where(F.col("n_term") >= support),
        "words",
    )
    most, n_words = (
        kept.agg(F.coalesce(F.max("n_entity"), F.lit(1))).first()[0],
        words.agg(F.coalesce(F.sum("n_term"), F.lit(1))).first()[0],
    )
    terms = (
        texts.join(kept.select("copy").distinct(), "copy", "left_semi")
        .select("copy", F.explode(F.array_distinct(F.transform(_free_terms(F.col("text"), F.col("base")), lambda t: F.lower(t["value"])))).alias("term"))
        .withColumn("word", F.xxhash64("term"))
    )
    possible = _can_disclose(n, generalise)
    rare = stage(
        attach(terms, words, ["word"], "n_term", n_words)
        .withColumn("n_entity", F.lit(most))
        .where(possible)
        .select("copy", "term", "n_term"),
        "terms",
    )
    pairs = kept.join(rare, "copy").where(possible)
    disclosing = stage(_disclosing(pairs, n, support, generalise), "disclosing")
    uses = max(1, disclosing.agg(F.coalesce(F.sum("n_both"), F.lit(0))).first()[0])
    marks = (
        attach(pairs.select("copy", "entity", "term"), disclosing, ["entity", "term"], "n_both", uses)
        .groupBy("copy", "term")
        .agg(F.max("share").alias("share"))
        .groupBy("copy")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    )
    share = lambda t: F.try_element_at("shares", F.lower(t["value"]))
    spans = F.transform(
        F.filter(_free_terms(F.col("text"), F.col("base")), lambda t: share(t).isNotNull()),
        lambda t: F.struct(
            t["start"].alias("start"),
            F.lit(len(KINDS)).alias("order"),
            t["end"].alias("end"),
            F.when(share(t) >= remove, "remove").otherwise("generalise").alias("kind"),
        ),
    )
    marked = stage(texts.join(marks, "copy").select("copy", "weight", spans.alias("added")), "marked")
    added = attach(named.select("row", "copy"), marked, ["copy"], "weight", max(1, n)).select("row", "added")
    found = F.array_sort(F.concat("base", F.coalesce("added", F.array_except("base", "base"))))
    return (
        own.join(added, "row", "left")
        .select("doc_id", "base", found.alias("found"))
        .select(
            "doc_id",
            *(count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS),
            (F.size("found") - F.size("base")).cast("long").alias("n_terms"),
            F.sha2(F.encode(joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
            joined(F.col("found")).alias("spans"),
            "found",
        )
    )


def sanitised(text: str | Column, found: str | Column) -> Column:
    """The text with each span replaced by its kind in brackets, and ``remove`` spans taken out."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.col(found) if isinstance(found, str) else found
    return replaced(
        F.coalesce(text, F.lit("")),
        found,
        lambda s: F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", "[TERM]").otherwise(
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        ),
    )
