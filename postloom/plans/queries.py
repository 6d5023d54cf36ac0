"""One query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import operators as ops
from postloom.functions import complexity, readability, repeatability, uri_author, word_count
from postloom.plans import jobs
from postloom.plans import testdata as data
from postloom.plans.scratch import scratch_path
from postloom.plans.vocabulary import LABEL_WEIGHTS, LEXICON, LONG_LEXICON, PHRASES, STEM_LEXICON
from postloom.schemas import COMPOSITES, LABEL_PREFIX, LEXICON as LEXICON_SCHEMA, REPOST
from postloom.sinks import write_by_date, write_csv
from postloom.sources import (
    missing_columns,
    read_actions_csv,
    read_firehose,
    read_lexicon,
    read_posts,
    read_user_list,
)
from postloom.sources.catalogue import list_files

Query = Callable[[SparkSession, str], DataFrame]

WORDS = ops.Lexicon.from_dict(LEXICON)
STEMS = ops.Lexicon.from_dict(STEM_LEXICON)
PLACES = 6


def _flat_langs(df: DataFrame) -> DataFrame:
    return df.withColumn("langs", F.array_join("langs", ","))


def _rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES) for c in cols})


def _lexicon_table(spark: SparkSession, categories: dict[str, list[str]]) -> DataFrame:
    rows = [
        (i, name, word, word.endswith("*"), j)
        for i, (name, words) in enumerate(categories.items(), start=1)
        for j, word in enumerate(words)
    ]
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


def repost_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_langs(ops.repost_edges(data.firehose(spark, sf_dir), same_day=False))


def repost_edges_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_langs(ops.repost_edges(data.firehose(spark, sf_dir), same_day=True))


def repost_edges_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = ops.repost_edges(data.firehose(spark, sf_dir), same_day=False)
    return ops.order_by_time(edges, "repost_created_at", ["source", "post_id"]).select(
        "source", "target", "post_id", "repost_created_at"
    )


def english_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.english_posts(data.firehose(spark, sf_dir)).select(
        "author", "uri", "cid", F.length("text").alias("n_chars")
    )


def uri_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        data.firehose(spark, sf_dir)
        .where(F.col("type") == REPOST)
        .groupBy(uri_author("subject.uri").alias("original_author"))
        .agg(F.count(F.lit(1)).alias("n_reposts"))
    )


def user_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_langs(
        ops.user_posts(data.firehose(spark, sf_dir), data.target_users(spark, sf_dir))
    )


def unique_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unique_posts(data.posts(spark, sf_dir))


def user_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.user_action_counts(data.firehose(spark, sf_dir).select("author", "type"))


def _counts(lexicon: ops.Lexicon, spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return ops.lexicon_counts(data.texts(spark, sf_dir), "text", lexicon, **options).drop("text")


def lexicon_counts_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _counts(WORDS, spark, sf_dir, normalized=True)
    return _rounded(counted, list(LEXICON))


def lexicon_counts_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems, phrases with words of their own, and a category of very many words."""
    short = _lexicon_table(spark, STEM_LEXICON | {"phrases": PHRASES})
    long = spark.range(LONG_LEXICON).select(
        F.lit(len(STEM_LEXICON) + 2).alias("cat_idx"),
        F.lit("long").alias("cat_name"),
        F.concat(F.when(F.col("id") % 2 == 0, "th").otherwise("on"), F.conv("id", 10, 36)).alias("keyword"),
        F.lit(False).alias("is_stem"),
        F.col("id").alias("entry"),
    )
    table = short.unionByName(long.withColumn("keyword", F.lower("keyword")))
    return ops.lexicon_counts_join(data.texts(spark, sf_dir), "text", table, ["doc_id"])


def lexicon_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lexicon_features(data.texts(spark, sf_dir), "text", WORDS)


def lexicon_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ops.lexicon_vector(data.texts(spark, sf_dir), "text", STEMS)
    joined = F.array_join(F.col("lexicon_vector").cast("array<string>"), ",")
    return vectors.select("doc_id", joined.alias("lexicon_vector"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.texts(spark, sf_dir).select("doc_id", word_count("text").alias("wordCount"))


def lexicon_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lexicon_composites(_counts(WORDS, spark, sf_dir)).select(
        "doc_id", *[F.col(f"`{name}`") for name in COMPOSITES]
    )


def _statistic(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    column = {
        "repeatability": repeatability("text"),
        "complexity": complexity("text"),
        "readability": readability("text"),
    }[name]
    return data.texts(spark, sf_dir).select("doc_id", F.round(column, PLACES).alias(name))


def linguistic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["repeatability", "complexity", "readability"]
    df = ops.linguistic_features(data.texts(spark, sf_dir), "text").drop("text")
    return _rounded(df, names)


def describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = ops.lexicon_features(data.texts(spark, sf_dir), "text", WORDS).drop("doc_id")
    return _rounded(
        ops.describe_features(features), ["mean", "std", "min", "p25", "p50", "p75", "max"]
    )


def describe_event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = data.table(spark, sf_dir, "events").select("value", "user_id")
    return _rounded(
        ops.describe_features(values), ["mean", "std", "min", "p25", "p50", "p75", "max"]
    )


def _result_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """English posts of the user list against all posts long enough."""
    stream = data.firehose(spark, sf_dir)
    left = ops.user_posts(stream, data.target_users(spark, sf_dir))
    right = data.posts(spark, sf_dir).where(F.length("text") >= 15)
    return left, right, ["author", "post_id", "post_cid"]


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reconcile(*_result_sets(spark, sf_dir))


def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = ops.reconcile_summary(*_result_sets(spark, sf_dir))
    return summary.withColumn("n_joined", F.col("n_joined").cast("long"))


def unmatched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right, keys = _result_sets(spark, sf_dir)
    return ops.unmatched_rows(left, right, keys).select(*keys, "createdAt", "side")


def sample_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sample_users(data.firehose(spark, sf_dir), 50)


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sample_rows(data.texts(spark, sf_dir), 100, keys=["doc_id"])


def sample_rows_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sample_rows(data.texts(spark, sf_dir), 100)


def score_text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six models, trained on six different columns of the labelled documents, over all documents."""
    texts = data.texts(spark, sf_dir)
    documents, labels = data.table(spark, sf_dir, "documents"), data.table(spark, sf_dir, "labels")
    labelled = documents.join(labels, "doc_id").select(
        "text",
        F.col("quality").alias("anxiety"),
        F.col("toxic").alias("stress"),
        (F.col("lang") == "en").cast("int").alias("depression"),
        (F.col("lang") == "fr").cast("int").alias("suicide"),
        (F.col("n_chars") > 1500).cast("int").alias("psychosis"),
        F.greatest(1 - F.col("quality"), "toxic").alias("loneliness"),
    )
    # read again at each step of the fits, so worth one even shuffle
    even = labelled.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    models = ops.train_text_labels(even, "text", {c: c for c in labelled.columns if c != "text"})
    return ops.score_text_labels(texts, "text", models).drop("text")


def _weighted_models(spark: SparkSession) -> ops.TextLabelModels:
    """Six models from fixed weights, saved and loaded again."""
    path = scratch_path(spark, "models")
    ops.save_text_models(spark, ops.text_labels_from_weights(spark, LABEL_WEIGHTS), path)
    return ops.load_text_models(spark, path)


def weighted_text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = data.texts(spark, sf_dir)
    return ops.score_text_labels(texts, "text", _weighted_models(spark)).drop("text")


def annotate_longest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of one text, the longest."""
    text = data.texts(spark, sf_dir).agg(F.max_by("text", F.struct(F.length("text"), "doc_id"))).first()[0]
    models = _weighted_models(spark)
    rows = list(zip(models.labels, ops.annotate_text(spark, text, models)))
    return spark.createDataFrame(rows, "label string, prediction double")


_inputs: dict[tuple[str, str, str], tuple[tuple, str]] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells one state of the tables' files from another."""
    files = list_files(spark, [f"{sf_dir}/{name}.parquet" for name in data.SCHEMAS])
    return tuple(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "length", "modified"))).first())


def _input_files(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Files that a query reads; only their reading is the query's work.

    They are written once per application, and again when the tables' files have changed.
    """
    key, state = (spark.sparkContext.applicationId, sf_dir, name), _state(spark, sf_dir)
    if key not in _inputs or _inputs[key][0] != state:
        path = scratch_path(spark, name)
        write(path)
        _inputs[key] = (state, path)
    return _inputs[key][1]


def _event_files(spark: SparkSession, sf_dir: str) -> str:
    """The event records as gzipped line-delimited JSON, one folder per day."""

    def write(path: str) -> None:
        records = data.firehose(spark, sf_dir).write.partitionBy("ingest_date")
        records.option("compression", "gzip").json(path)

    return _input_files(spark, sf_dir, "events", write)


def user_posts_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_firehose(spark, _event_files(spark, sf_dir))
    return _flat_langs(ops.user_posts(records, data.target_users(spark, sf_dir)))


def _user_list_file(spark: SparkSession, users: DataFrame) -> str:
    """One JSON object whose keys are the users."""
    path = scratch_path(spark, "users")
    pairs = F.map_from_entries(F.collect_list(F.struct("author", F.lit(1))))
    users.coalesce(1).agg(F.to_json(pairs).alias("value")).write.text(path)
    return path


def user_posts_from_user_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read_user_list(spark, _user_list_file(spark, data.target_users(spark, sf_dir)))
    return _flat_langs(ops.user_posts(data.firehose(spark, sf_dir), users))


def user_posts_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job for all authors, then again for fewer: what the second run leaves."""
    events, output = _event_files(spark, sf_dir), scratch_path(spark, "user-posts")
    everyone = data.firehose(spark, sf_dir).select("author").distinct()
    for users in (everyone, data.target_users(spark, sf_dir)):
        table = scratch_path(spark, "users")
        users.write.parquet(table)
        jobs.user_posts_job(spark, events, table, output, users_form="table")
    posts = spark.read.parquet(output).withColumn("ingest_date", F.col("ingest_date").cast("string"))
    return _flat_langs(ops.order_by_time(posts, "createdAt", ["author", "post_id"]))


def repost_edges_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = scratch_path(spark, "edges")
    jobs.repost_edges_job(spark, _event_files(spark, sf_dir), output)
    edges = spark.read.parquet(output)
    return _flat_langs(edges.withColumn("ingest_date", F.col("ingest_date").cast("string")))


def _event_lines(spark: SparkSession, sf_dir: str) -> str:
    """The event records of the documents as lines, each followed by a part of itself, which is broken."""
    path = f"{scratch_path(spark, 'lines')}/2024-01-01"
    line = F.to_json(F.struct(*[c for c in data.firehose(spark, sf_dir).columns if c != "ingest_date"]))
    data.firehose(spark, sf_dir).select(
        F.explode(F.array(line, F.left(line, F.length(line) - 5))).alias("value")
    ).write.text(path)
    return path


def firehose_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_firehose(spark, _event_lines(spark, sf_dir), on_bad="keep")
    broken = F.when(F.col("_corrupt_record").isNotNull(), "broken").otherwise("good")
    return records.groupBy("type", broken.alias("line")).agg(F.count(F.lit(1)).alias("n"))


def firehose_first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_firehose(spark, _event_lines(spark, sf_dir), limit=100, require_records=True)
    return records.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("author").isNull()).alias("n_bad"))


def action_counts_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are written too, line breaks included; the result is in the order of its keys."""
    actions = data.firehose(spark, sf_dir).select("createdAt", "author", "text", "type")
    path = _input_files(spark, sf_dir, "actions", lambda path: write_csv(actions, path))
    return ops.user_action_counts(read_actions_csv(spark, path)).orderBy("author")


def _post_files(spark: SparkSession, sf_dir: str) -> str:
    """``data.posts`` by day; a post is dealt and sorted once, and repeated as it is written."""
    by_day = data.first_posts(spark, sf_dir).withColumn("ingest_date", F.left("createdAt", F.lit(10)))

    def write(path: str) -> None:
        write_by_date(by_day, path, order_by=["createdAt", "post_id"], then=data.repeated_untagged)

    return _input_files(spark, sf_dir, "posts", write)


def unique_posts_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unique_posts(read_posts(spark, _post_files(spark, sf_dir)))


def unique_posts_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job twice: the second run replaces the first."""
    posts, output = _post_files(spark, sf_dir), scratch_path(spark, "unique")
    jobs.unique_posts_job(spark, posts, output, dates=["2024-01-01"])
    jobs.unique_posts_job(spark, posts, output)
    return spark.read.parquet(output)


def posts_of_one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day, by its folder, by a pattern and by the list of dates."""
    path = _post_files(spark, sf_dir)
    ways = {
        "folder": read_posts(spark, f"{path}/ingest_date=2024-01-10", require_date=True),
        "pattern": read_posts(spark, f"{path}/ingest_date=2024-01-1*", require_date=True),
        "dates": read_posts(spark, path, dates=["2024-01-10"]),
    }
    columns = ["post_id", "langs", "ingest_date"]
    out = None
    for way, df in ways.items():
        df = _flat_langs(df.select(*columns)).withColumn("way", F.lit(way))
        out = df if out is None else out.unionByName(df)
    return out


def _lexicon_files(spark: SparkSession) -> tuple[str, str]:
    """The category map and the dictionary, tab-separated."""
    index = {name: i for i, name in enumerate(LEXICON, start=1)}
    words: dict[str, list[int]] = {}
    for name, keywords in LEXICON.items():
        for word in keywords:
            words.setdefault(word, []).append(index[name])
    lines = {
        "map": [f"{i}\t{name}" for name, i in index.items()],
        "dict": ["\t".join([word, *map(str, at)]) for word, at in words.items()],
    }
    paths = []
    for kind, content in lines.items():
        paths.append(scratch_path(spark, kind))
        spark.createDataFrame([(x,) for x in content], "value string").coalesce(1).write.text(paths[-1])
    return paths[0], paths[1]


def lexicon_features_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = ops.collect_lexicon(read_lexicon(spark, *_lexicon_files(spark)))
    return ops.lexicon_features(data.texts(spark, sf_dir), "text", lexicon)


def composites_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post files to category counts, and those to composites."""
    counts, output = scratch_path(spark, "counts"), scratch_path(spark, "composites")
    jobs.lexicon_job(spark, _post_files(spark, sf_dir), "text", *_lexicon_files(spark), counts)
    jobs.composites_job(spark, counts, output)
    return spark.read.parquet(output).select("post_id", *[F.col(f"`{name}`") for name in COMPOSITES])


def linguistic_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = scratch_path(spark, "linguistic")
    jobs.linguistic_job(spark, _post_files(spark, sf_dir), "text", output)
    names = ["repeatability", "complexity", "readability"]
    return _rounded(spark.read.parquet(output).select("post_id", *names), names)


def classifier_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, output = scratch_path(spark, "models"), scratch_path(spark, "labels")
    ops.save_text_models(spark, ops.text_labels_from_weights(spark, LABEL_WEIGHTS), models)
    jobs.classifier_job(spark, _post_files(spark, sf_dir), "text", models, output)
    return spark.read.parquet(output).select("post_id", *[LABEL_PREFIX + label for label in LABEL_WEIGHTS])


def day_without_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows every operator gives for a day that no record is of."""
    day = F.col("ingest_date") == "1999-01-01"
    records = data.firehose(spark, sf_dir).where(day)
    posts = read_posts(spark, _post_files(spark, sf_dir), dates=["1999-01-01"])
    users = data.target_users(spark, sf_dir)
    output = scratch_path(spark, "unique")
    jobs.unique_posts_job(spark, _post_files(spark, sf_dir), output, dates=["1999-01-01"])
    names = [f"{name}" for name in WORDS.categories]
    results = {
        "english_posts": ops.english_posts(records),
        "repost_edges": ops.repost_edges(records),
        "user_posts": ops.user_posts(records, users),
        "user_action_counts": ops.user_action_counts(records),
        "unique_posts": ops.unique_posts(posts),
        "unique_posts_job": spark.read.parquet(output),
        "lexicon_features": ops.lexicon_features(posts, "text", WORDS),
        "linguistic_features": ops.linguistic_features(posts, "text"),
        "describe_features": ops.describe_features(ops.lexicon_features(posts, "text", WORDS), names[:2]),
        "score_text_labels": ops.score_text_labels(posts, "text", _weighted_models(spark)),
        "order_by_time": ops.order_by_time(posts, "createdAt"),
        "sample_users": ops.sample_users(posts, 10),
        "sample_rows": ops.sample_rows(posts, 10),
    }
    counts = [df.agg(F.lit(name).alias("operator"), F.count(F.lit(1)).alias("n")) for name, df in results.items()]
    return reduce(DataFrame.unionByName, counts)


def columns_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns of a post each table lacks."""
    rows = [
        (name, column)
        for name in ("documents", "events", "labels")
        for column in missing_columns(data.table(spark, sf_dir, name), ["author", "doc_id", "text", "ts"])
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def queries() -> dict[str, Query]:
    return {
        "repost_edges": repost_edges,
        "repost_edges_same_day": repost_edges_same_day,
        "repost_edges_ordered": repost_edges_ordered,
        "english_posts": english_posts,
        "uri_author": uri_authors,
        "user_posts": user_posts,
        "unique_posts": unique_posts,
        "user_action_counts": user_action_counts,
        "lexicon_counts_regex": partial(_counts, WORDS, strategy="regex"),
        "lexicon_counts_token": partial(_counts, WORDS, strategy="token"),
        "lexicon_counts_stem": partial(_counts, STEMS, strategy="token"),
        "lexicon_counts_stem_regex": partial(_counts, STEMS, strategy="regex"),
        "lexicon_counts_stem_ignored": partial(_counts, STEMS, stems="ignore"),
        "lexicon_counts_join": lexicon_counts_join,
        "lexicon_counts_normalized": lexicon_counts_normalized,
        "lexicon_features": lexicon_features,
        "lexicon_vector": lexicon_vector,
        "word_count": words,
        "lexicon_composites": lexicon_composites,
        "repeatability": partial(_statistic, "repeatability"),
        "complexity": partial(_statistic, "complexity"),
        "readability": partial(_statistic, "readability"),
        "linguistic_features": linguistic_features,
        "describe_features": describe_features,
        "describe_event_values": describe_event_values,
        "reconcile": reconcile,
        "reconcile_summary": reconcile_summary,
        "unmatched_rows": unmatched_rows,
        "sample_users": sample_users,
        "sample_rows": sample_rows,
        "sample_rows_random": sample_rows_random,
        "score_text_labels": score_text_labels,
        "user_posts_from_files": user_posts_from_files,
        "repost_edges_from_files": repost_edges_from_files,
        "action_counts_from_csv": action_counts_from_csv,
        "unique_posts_from_files": unique_posts_from_files,
        "weighted_text_labels": weighted_text_labels,
        "annotate_longest_text": annotate_longest_text,
        "user_posts_from_user_list": user_posts_from_user_list,
        "user_posts_rerun": user_posts_rerun,
        "firehose_bad_lines": firehose_bad_lines,
        "firehose_first_records": firehose_first_records,
        "unique_posts_job": unique_posts_job,
        "posts_of_one_day": posts_of_one_day,
        "lexicon_features_from_files": lexicon_features_from_files,
        "composites_job": composites_job,
        "linguistic_job": linguistic_job,
        "classifier_job": classifier_job,
        "day_without_records": day_without_records,
        "columns_missing": columns_missing,
    }
