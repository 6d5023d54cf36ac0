"""Newline-delimited JSON event files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.schemas import FIREHOSE, SUBJECT
from postloom.sources.dates import with_ingest_date

CORRUPT = "_corrupt_record"
BAD_RECORD_MODES = ("drop", "fail", "keep")

# ``subject`` is an object in reposts and likes but a plain id in follows, so a
# line is parsed with it as text and turned into a struct afterwards.
_LINE = T.StructType(
    [
        T.StructField(f.name, T.StringType() if f.name == "subject" else f.dataType)
        for f in FIREHOSE.fields
        if f.name != "ingest_date"
    ]
    + [T.StructField(CORRUPT, T.StringType())]
)


def read_firehose(
    spark: SparkSession,
    paths: str | Sequence[str],
    on_bad: str = "drop",
    limit: int | None = None,
    require_records: bool = False,
    require_date: bool = True,
    default_date: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Read (gzipped) event files under the declared schema.

    ``on_bad`` says what happens to a line that is no JSON object of the
    declared types: ``drop`` it, ``fail`` the query, or ``keep`` it with the
    line in ``_corrupt_record``. Lines are parsed whole, so which lines are bad
    does not depend on the columns a query selects. ``limit`` keeps that many
    valid records, for a look at a few files; ``require_records`` raises
    ``ValueError`` if none is valid.

    A gzip file is one task. ``partitions`` spreads the parsed records when
    there are fewer files than cores.
    """
    if on_bad not in BAD_RECORD_MODES:
        raise ValueError(f"on_bad must be one of {BAD_RECORD_MODES}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = with_ingest_date(spark.read.text(paths), require_date, default_date)
    options = {
        "mode": "FAILFAST" if on_bad == "fail" else "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
    }
    # a generator keeps the parsed record as one value: without it each later filter would parse again
    records = lines.select(
        F.explode(F.array(F.from_json("value", _LINE, options))).alias("r"), "value", "ingest_date"
    )
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    if on_bad == "drop":
        records = records.where(~bad)

    subject = F.col("r.subject")
    columns = {f.name: F.col(f"r.{f.name}") for f in FIREHOSE.fields if f.name != "ingest_date"}
    columns["subject"] = F.when(subject.startswith("{"), F.from_json(subject, SUBJECT))
    columns["ingest_date"] = F.col("ingest_date")
    if on_bad == "keep":
        columns[CORRUPT] = F.when(bad, F.col("value"))
    records = records.select(*[c.alias(name) for name, c in columns.items()])

    if limit is not None:
        records = records.limit(limit)
    if require_records and records.isEmpty():
        raise ValueError(f"None of the lines in {paths} is a valid record")
    return records.repartition(partitions) if partitions else records
