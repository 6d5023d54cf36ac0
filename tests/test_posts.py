from pyspark.sql import functions as F

from postloom.operators import unique_posts, user_posts
from postloom.plans.sizing import broadcast_if_small
from tests.records import follow, frame, post, repost


def _users(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "author string")


def test_user_posts_keeps_any_record_with_the_language(spark):
    p = post("u1", "1", text="short")
    rows = [
        p,
        p,
        post("u1", "2", action="delete"),
        post("u1", "3", langs=["fi"]),
        post("u2", "4"),
        repost("u1", p),
        follow("u1", "u2") | {"subject": None},
    ]
    out = user_posts(frame(spark, rows), _users(spark, "u1", "u1", "o'brien"))
    assert sorted(r.post_cid for r in out.collect()) == ["cid-1", "cid-2"]
    assert out.columns[:7] == [
        "author", "createdAt", "type", "post_id", "post_cid", "text", "langs",
    ]


def test_user_posts_with_no_users(spark):
    assert user_posts(frame(spark, [post("u", "1")]), _users(spark)).count() == 0


def test_user_posts_without_day_column(spark):
    df = frame(spark, [post("u", "1")]).drop("ingest_date")
    assert user_posts(df, _users(spark, "u")).columns[-1] == "langs"


def test_long_user_list_is_not_broadcast(spark):
    users = _users(spark, *[f"u{i}" for i in range(50)])
    hinted = broadcast_if_small(users)._jdf.queryExecution().analyzed().toString()
    plain = broadcast_if_small(users, max_rows=10)._jdf.queryExecution().analyzed().toString()
    wide = broadcast_if_small(users, max_bytes=10)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in hinted and "broadcast" not in plain + wide


def test_unique_posts(spark):
    base = dict(author="a", createdAt="t", type="p", post_id="1", post_cid="c", text="x")
    rows = [
        {**base, "langs": ["en"]},
        {**base, "langs": ["en", "fi"]},
        {**base, "langs": None},
        {**base, "post_cid": "d", "langs": ["en"]},
        {**base, "text": None, "langs": ["en"]},
        {**base, "text": None, "langs": []},
    ]
    df = spark.createDataFrame(
        [tuple(r.values()) for r in rows],
        "author string, createdAt string, type string, post_id string, post_cid string, "
        "text string, langs array<string>",
    )
    out = unique_posts(df)
    assert out.count() == 3
    assert "langs" not in out.columns
    assert unique_posts(out).count() == 3
    assert unique_posts(df.unionAll(df).repartition(5)).count() == 3
    assert out.where(F.col("text").isNull()).count() == 1
