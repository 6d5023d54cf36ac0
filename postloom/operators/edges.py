"""Repost edges: who reposted whose post."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions import has_lang, is_create, is_kind, min_length
from postloom.plans.keyfilter import keep_partners
from postloom.schemas import LANGUAGE, MIN_TEXT_LENGTH, POST, REPOST


def english_posts(
    firehose: DataFrame, min_len: int = MIN_TEXT_LENGTH, lang: str = LANGUAGE
) -> DataFrame:
    """Created posts of at least ``min_len`` characters tagged with ``lang``."""
    return firehose.where(
        is_create() & is_kind(POST) & min_length(n=min_len) & has_lang(lang=lang)
    )


def repost_edges(
    firehose: DataFrame,
    min_len: int = MIN_TEXT_LENGTH,
    lang: str = LANGUAGE,
    same_day: bool = True,
    key_filter: bool = False,
) -> DataFrame:
    """One row per distinct repost of a qualifying post.

    ``same_day=True`` matches a repost only with a post ingested on the same
    day and keeps ``ingest_date`` in the output; ``False`` matches across days.

    A post's content (author, text, tags) gets a digest, and copies of reposts and
    posts are removed before the join; what is joined and made distinct then are
    narrow rows, however often a long text is reposted. A viral post is one row on
    the post side and many reposts, which the adaptive skew join splits. The
    texts come back last, one row for each content.

    Most reposts are of posts that don't qualify. ``key_filter=True`` drops nearly
    all of them where they are read, before anything is shuffled, by a bitmap of the
    qualifying posts' keys. That reads the posts' keys twice more, which pays
    where the records are staged by kind.
    """
    day = ["ingest_date"] if same_day else []
    keys = ["post_id", "post_cid", *day]

    reposts = firehose.where(is_create() & is_kind(REPOST)).select(
        F.col("author").alias("source"),
        F.col("subject.uri").alias("post_id"),
        F.col("subject.cid").alias("post_cid"),
        F.col("createdAt").alias("repost_created_at"),
        *day,
    )
    content = F.struct(F.col("author").alias("target"), "text", "langs")
    posts = english_posts(firehose, min_len, lang).select(
        F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256).alias("content"),
        "author", "text", "langs",
        F.col("uri").alias("post_id"),
        F.col("cid").alias("post_cid"),
        *day,
    )
    if key_filter:
        reposts = keep_partners(reposts, posts.select(*keys), keys)
    contents = posts.select("content", F.col("author").alias("target"), "text", "langs").dropDuplicates(["content"])
    edges = (
        reposts.distinct()
        .join(posts.select("content", *keys).distinct(), keys, "inner")
        .select("source", "post_id", "repost_created_at", "content", *day)
        .distinct()
    )
    return edges.join(contents, "content").select(
        "source", "target", "post_id", "repost_created_at", "text", "langs", *day
    )
