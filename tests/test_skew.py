"""One key or one group of copies holds a third of all rows or more."""

import pytest
from pyspark.sql import functions as F

from postloom.operators import (
    lexicon,
    lexicon_counts_join,
    posts,
    repost_edges,
    unique_posts,
    user_action_counts,
    user_posts,
)
from postloom.schemas import FIREHOSE, LEXICON, POST, REPOST

N = 60_000


@pytest.fixture
def shuffled(spark):
    """Joins without broadcast, and thresholds that fit small data."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key in settings:
        spark.conf.unset(key)


def _stream(spark):
    """N reposts, two thirds of them of one post, and 1000 copies of that post."""
    reposts = spark.range(0, N, numPartitions=8).select(
        F.lit("create").alias("action"),
        F.lit(REPOST).alias("type"),
        F.concat(F.lit("u"), "id").alias("author"),
        F.concat(F.lit("t"), "id").alias("createdAt"),
        F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.col("id") % 500).alias("k"),
    )
    subject = F.struct(F.concat(F.lit("p"), "k").alias("uri"), F.concat(F.lit("c"), "k").alias("cid"))
    reposts = reposts.withColumn("subject", subject).drop("k")
    posts = spark.range(0, 1500, numPartitions=8).select(
        F.lit("create").alias("action"),
        F.lit(POST).alias("type"),
        F.lit("author").alias("author"),
        F.lit("t").alias("createdAt"),
        F.greatest(F.col("id") - 1000, F.lit(0)).alias("k"),
    )
    posts = posts.select(
        "*",
        F.concat(F.lit("p"), "k").alias("uri"),
        F.concat(F.lit("c"), "k").alias("cid"),
        F.concat(F.lit("text of the post number "), "k").alias("text"),
        F.array(F.lit("en")).alias("langs"),
    ).drop("k")
    both = posts.unionByName(reposts, allowMissingColumns=True)
    return both.withColumn("ingest_date", F.lit("2025-01-01")).select(*FIREHOSE.names)


def test_viral_post_is_split_and_complete(shuffled):
    edges = repost_edges(_stream(shuffled))
    assert len(edges.collect()) == N
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan


def test_copies_are_collapsed_before_the_shuffle(shuffled):
    df = _stream(shuffled).where(F.col("type") == POST).select(
        F.col("uri").alias("post_id"),
        F.col("cid").alias("post_cid"),
        "author",
        "createdAt",
        "type",
        "text",
    )
    out = unique_posts(df)
    assert len(out.collect()) == 500
    plan = out._jdf.queryExecution().executedPlan().toString()
    below_exchange = plan.split("Exchange", 1)[1]
    assert "HashAggregate" in below_exchange


def test_hot_author(shuffled):
    df = _stream(shuffled).withColumn(
        "author", F.when(F.col("type") == REPOST, F.lit("bot")).otherwise(F.col("author"))
    )
    counts = {r.author: r.reposts for r in user_action_counts(df).collect()}
    assert counts["bot"] == N
    users = shuffled.createDataFrame([("author",), ("bot",)], "author string")
    assert user_posts(df, users).count() == 500


def test_hot_author_of_a_long_user_list_is_split(shuffled, monkeypatch):
    monkeypatch.setattr(posts, "broadcast_if_small", lambda df: df)
    stream = _stream(shuffled).withColumns(
        {
            "author": F.when(F.col("createdAt").endswith("7"), "rare").otherwise(F.lit("bot")),
            "langs": F.array(F.lit("en")),
        }
    )
    users = shuffled.createDataFrame([("bot",), ("x",)], "author string")
    out = user_posts(stream, users)
    want = stream.where("author = 'bot' AND uri IS NULL").count() + 500
    assert len(out.collect()) == want
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_hot_word_is_split(shuffled, monkeypatch):
    """A word that makes up most of all texts, with a lexicon too big to broadcast."""
    monkeypatch.setattr(lexicon, "broadcast_if_small", lambda df: df)
    df = shuffled.range(0, 100_000, numPartitions=8).selectExpr(
        "id", "concat('the the the the word', id % 300, ' theory') AS text"
    )
    table = shuffled.createDataFrame(
        [(1, "a", "the", False, 0), (1, "a", "theo*", True, 1), (2, "b", "word*", True, 2)],
        LEXICON,
    )
    out = lexicon_counts_join(df, "text", table, ["id"])
    rows = out.collect()
    assert len(rows) == 100_000 and {(r.a, r.b) for r in rows} == {(5, 1)}
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
