"""Post tables: posts of a user list, unique posts over all daily files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions import has_lang
from postloom.plans.sizing import broadcast_if_small
from postloom.schemas import LANGUAGE

POST_KEY = ["post_id", "post_cid", "author", "createdAt", "type", "text"]


def user_posts(firehose: DataFrame, users: DataFrame, lang: str = LANGUAGE) -> DataFrame:
    """Distinct records tagged ``lang`` whose author is in ``users.author``.

    No filter on action, kind or length. The list is broadcast when its
    measured size allows it, so the firehose is not shuffled before it is
    reduced; a longer list falls back to a shuffled semi join. A
    ``ingest_date`` column, if present, is kept.
    """
    day = ["ingest_date"] if "ingest_date" in firehose.columns else []
    members = broadcast_if_small(users.select("author"))
    return (
        firehose.where(has_lang(lang=lang))
        .join(members, "author", "left_semi")
        .select(
            "author",
            "createdAt",
            "type",
            F.col("uri").alias("post_id"),
            F.col("cid").alias("post_cid"),
            "text",
            "langs",
            *day,
        )
        .distinct()
    )


def unique_posts(posts: DataFrame) -> DataFrame:
    """One row per distinct post over all days; language tags are left out."""
    return posts.select(*POST_KEY).distinct()
