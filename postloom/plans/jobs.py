"""Whole jobs: read files, run an operator, write a table by day.

A job takes any number of days at once; what one run per day did is the
``ingest_date`` partition here. Rerunning some days replaces just those.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import has_lang, is_create, is_kind, min_length
from postloom.operators.classify import load_text_models, score_text_labels
from postloom.operators.composites import lexicon_composites
from postloom.operators.describe import describe_features
from postloom.operators.edges import repost_edges
from postloom.operators.lexicon import collect_lexicon, lexicon_features
from postloom.operators.linguistic import linguistic_features
from postloom.operators.posts import unique_posts, user_posts
from postloom.plans.scratch import scratch_path
from postloom.schemas import FIREHOSE, LANGUAGE, MIN_TEXT_LENGTH, POST, REPOST, STOP_WORDS, TEXT_LABELS
from postloom.sinks import remove, write_by_date, write_table
from postloom.sources import dates_of_files, read_firehose, read_lexicon, read_posts, read_users

Paths = str | Sequence[str]
UNKNOWN_DATE = "unknown_date"


def stage_firehose(
    spark: SparkSession,
    firehose: DataFrame,
    path: str,
    min_len: int = MIN_TEXT_LENGTH,
    lang: str = LANGUAGE,
) -> DataFrame:
    """Write what the edge join reads once as Parquet by day and kind, and read it back.

    JSON is parsed a single time then. Posts that don't qualify and columns that
    the join doesn't read are left out before; an event file is of one day
    already, so its records are written where they were parsed.
    """
    posts = is_kind(POST) & min_length(n=min_len) & has_lang(lang=lang)
    needed = firehose.where(is_create() & (is_kind(REPOST) | posts))
    needed.select(
        "action", "type", "author", "createdAt", "uri", "cid", "text", "langs", "subject", "ingest_date"
    ).write.partitionBy("ingest_date", "type").parquet(path)
    return spark.read.schema(FIREHOSE).parquet(path)


def repost_edges_job(
    spark: SparkSession,
    input: Paths,
    output: str,
    staging: str | None = None,
    min_len: int = MIN_TEXT_LENGTH,
    lang: str = LANGUAGE,
) -> None:
    """Event files -> repost edges of each day, in time order; a rerun replaces all days of the input.

    ``staging`` is a folder for the staged records; each run uses its own
    subfolder of it and removes that afterwards.
    """
    path = f"{staging.rstrip('/')}/run-{uuid.uuid4().hex}" if staging else scratch_path(spark, "firehose")
    try:
        staged = stage_firehose(spark, read_firehose(spark, input), path, min_len, lang)
        write_by_date(
            repost_edges(staged, min_len, lang, same_day=True, key_filter=True),
            output,
            order_by=["repost_created_at", "source", "post_id"],
            days=dates_of_files(spark, _listed(input)),
        )
    finally:
        remove(spark, path)


def _listed(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def user_posts_job(
    spark: SparkSession, input: Paths, users: str, output: str, lang: str = LANGUAGE, users_form: str = "json"
) -> None:
    """Event files and a user list -> those users' posts by day, in time order.

    A rerun replaces all days of the input, those without any post included.
    ``users_form`` tells a JSON document from the forms for long lists, lines
    and tables.
    """
    posts = user_posts(read_firehose(spark, input), read_users(spark, users, users_form), lang)
    days = dates_of_files(spark, _listed(input))
    write_by_date(posts, output, order_by=["createdAt", "author", "post_id"], days=days)


def unique_posts_job(
    spark: SparkSession, input: Paths, output: str, dates: Sequence[str] | None = None, store: str | None = None
) -> None:
    """Daily post files -> one table of unique posts; ``store`` keeps the catalogue of the files."""
    write_table(unique_posts(read_posts(spark, input, dates, store=store)), output)


def lexicon_job(
    spark: SparkSession,
    input: Paths,
    text_column: str,
    map_path: str,
    dict_path: str,
    output: str,
    stems: str = "match",
    dates: Sequence[str] | None = None,
) -> DataFrame:
    """Post files -> category counts by day; returns a description of those days."""
    lexicon = collect_lexicon(read_lexicon(spark, map_path, dict_path))
    posts = read_posts(spark, input, dates, require_date=True).where(is_kind(POST))
    write_by_date(lexicon_features(posts, text_column, lexicon, stems=stems), output)
    days = list(dates) if dates is not None else dates_of_files(spark, _listed(input))
    written = _dated(spark.read.parquet(output)).where(F.col("ingest_date").isin(days))
    return describe_features(written, ["wordCount", *lexicon.categories])


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("ingest_date", F.col("ingest_date").cast("string"))


def composites_job(spark: SparkSession, input: str, output: str) -> None:
    """Category counts by day -> the same with composite scores."""
    write_by_date(lexicon_composites(_dated(spark.read.parquet(input))), output)


def linguistic_job(
    spark: SparkSession,
    input: Paths,
    text_column: str,
    output: str,
    stop_words: Sequence[str] = STOP_WORDS,
    dates: Sequence[str] | None = None,
) -> None:
    """Post files -> text statistics by day; undated files go to one partition."""
    posts = read_posts(spark, input, dates, default_date=UNKNOWN_DATE)
    write_by_date(linguistic_features(posts, text_column, stop_words), output)


def classifier_job(
    spark: SparkSession,
    input: Paths,
    text_column: str,
    models: str,
    output: str,
    labels: Sequence[str] = tuple(TEXT_LABELS),
    dates: Sequence[str] | None = None,
) -> None:
    """Post files and saved models -> one prediction column per label, by day."""
    posts = read_posts(spark, input, dates, require_date=True)
    bundle = load_text_models(spark, models, labels)
    write_by_date(score_text_labels(posts, text_column, bundle).drop(text_column), output)
