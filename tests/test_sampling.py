from postloom.operators import sample_rows, sample_users


def test_users_are_distinct_and_repeatable(spark):
    df = spark.range(1000).selectExpr(
        "CASE WHEN id % 10 = 0 THEN NULL ELSE concat('u', id % 200) END AS author"
    )
    first = [r.author for r in sample_users(df, 20, seed=1).collect()]
    again = [r.author for r in sample_users(df.repartition(7), 20, seed=1).collect()]
    other = [r.author for r in sample_users(df, 20, seed=2).collect()]
    assert first == again != other
    assert len(set(first)) == 20 and None not in first


def test_users_are_capped_at_what_there_is(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "author string")
    assert sample_users(df, 10).count() == 2


def test_rows(spark):
    df = spark.range(500)
    assert sample_rows(df, 30).distinct().count() == 30
    assert sample_rows(df, 900).count() == 500
    keyed = [r.id for r in sample_rows(df, 30, keys=["id"]).collect()]
    assert keyed == [r.id for r in sample_rows(df.repartition(5), 30, keys=["id"]).collect()]


def test_sampling_sorts_no_whole_table(spark):
    plan = sample_rows(spark.range(500), 30)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_rows_of_files_are_drawn_by_their_place(spark, tmp_path):
    spark.range(0, 3000).repartition(3).write.parquet(str(tmp_path / "t"))
    draws = []
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = spark.read.parquet(str(tmp_path / "t")).select("id")
        draws.append([r.id for r in sample_rows(df, 40).collect()])
        other = [r.id for r in sample_rows(df, 40, seed=1).collect()]
        assert len(set(draws[-1])) == 40 and other != draws[-1]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert draws[0] == draws[1]
    assert df.rdd.getNumPartitions() != 0 and sample_rows(df, 5000).columns == ["id"]
