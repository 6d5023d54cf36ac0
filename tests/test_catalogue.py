import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from postloom.sources import catalogue, file_report, read_posts
from postloom.sources.catalogue import readable_rows

POST = {"author": ["a"], "createdAt": ["t"], "type": ["p"], "post_id": ["1"], "post_cid": ["c"], "text": ["x"]}


def write(path, rows=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({k: v * rows for k, v in POST.items()}), path)


def opened(df):
    """How many files the scan of a frame opened."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numFiles").value()


@pytest.fixture
def days(tmp_path):
    names = [f"2025-{m:02}-{d:02}" for m in range(1, 13) for d in range(1, 26)]
    for name in names:
        write(tmp_path / "posts" / f"users_posts_{name}.parquet")
    return str(tmp_path / "posts")


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_one_day_opens_its_own_footers_only(spark, days, plain_plans):
    assert opened(readable_rows(spark, days, ["2025-03-04"])) == 1
    assert opened(readable_rows(spark, days)) == 300
    assert opened(readable_rows(spark, days, ["2030-01-01"])) == 0


def test_a_day_of_damaged_others(spark, days, caplog):
    for name in os.listdir(days):
        if "2025-03-04" not in name:
            open(f"{days}/{name}", "wb").write(b"PAR1 is no table PAR0")
    with caplog.at_level("WARNING"):
        assert read_posts(spark, days, dates=["2025-03-04"]).count() == 1
    assert not caplog.records
    assert file_report(spark, days, ["2025-03-04", "2025-03-05"]).where("valid").count() == 1


def test_known_files_are_not_opened_again(spark, days, tmp_path):
    store = str(tmp_path / "store")
    first = {r.path: r for r in catalogue(spark, days, store, ["2025-01-01", "2025-01-02"]).collect()}
    assert len(first) == 2 and all(r.valid and r.n_rows == 1 for r in first.values())
    assert spark.read.parquet(store).count() == 2

    # the same length and time, but no footer: only a second look could tell
    path = f"{days}/users_posts_2025-01-01.parquet"
    state = os.stat(path)
    open(path, "wb").write(b"x" * state.st_size)
    os.utime(path, ns=(state.st_atime_ns, state.st_mtime_ns))
    again = catalogue(spark, days, store, ["2025-01-01", "2025-01-02", "2025-01-03"])
    assert sorted((r.ingest_date, r.valid) for r in again.collect()) == [(f"2025-01-0{i}", True) for i in (1, 2, 3)]
    assert spark.read.parquet(store).count() == 3


def test_replaced_and_removed_files(spark, days, tmp_path):
    store, path = str(tmp_path / "store"), tmp_path / "posts" / "users_posts_2025-01-01.parquet"
    two = ["2025-01-01", "2025-01-02"]
    catalogue(spark, days, store, two).count()
    write(path, rows=5)
    os.utime(path, (2_000_000_000, 2_000_000_000))
    (tmp_path / "posts" / "users_posts_2025-01-02.parquet").unlink()
    assert [(r.ingest_date, r.n_rows) for r in catalogue(spark, days, store, two).collect()] == [("2025-01-01", 5)]
    path.write_bytes(b"junk")
    os.utime(path, (2_000_000_001, 2_000_000_001))
    assert [(r.valid, r.n_rows) for r in catalogue(spark, days, store, two).collect()] == [(False, 0)]
    assert spark.read.parquet(store).count() == 4


def test_read_posts_with_a_store(spark, days, tmp_path, caplog):
    store = str(tmp_path / "store")
    (tmp_path / "posts" / "users_posts_2025-01-02.parquet").write_bytes(b"junk")
    for _ in range(2):
        with caplog.at_level("WARNING"):
            rows = read_posts(spark, days, ["2025-01-01", "2025-01-02"], store=store)
            assert [r.ingest_date for r in rows.collect()] == ["2025-01-01"]
        assert "Skipped 1 of 2 post files (1 valid)" in caplog.records[-1].getMessage()
    assert spark.read.parquet(store).count() == 2


def test_undated_and_empty_files(spark, tmp_path):
    write(tmp_path / "p" / "plain.parquet")
    write(tmp_path / "p" / "2025-01-01.parquet", rows=0)
    (tmp_path / "p" / "2025-01-02.parquet").write_bytes(b"junk and more junk")
    where = str(tmp_path / "p")
    found = {r.path.rsplit("/", 1)[1]: (r.ingest_date, r.n_rows, r.valid) for r in catalogue(spark, where).collect()}
    assert found == {
        "plain.parquet": (None, 1, True),
        "2025-01-01.parquet": ("2025-01-01", 0, True),
        "2025-01-02.parquet": ("2025-01-02", 0, False),
    }
    assert read_posts(spark, where, ["none"], default_date="none").count() == 1
    assert read_posts(spark, where, ["2025-01-01"]).count() == 0
