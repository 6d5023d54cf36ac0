"""One query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import documents, fresh_path
from postloom.llm.contamination import contained_items
from postloom.llm.exact import exact_duplicates
from postloom.llm.jaccard import similar_documents
from postloom.llm.lines import without_frequent_lines
from postloom.llm.mixing import mix_sources
from postloom.llm.negatives import hard_negatives, shifted_labels
from postloom.llm.passages import repeated_passages
from postloom.llm.privacy import find_private
from postloom.llm.quality import score_quality
from postloom.llm.secrets import find_secrets
from postloom.llm.tokens import read_tokens, with_crc32, write_tokens
from postloom.llm.toxicity import score_toxicity
from postloom.llm.turns import audited, damaged

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER))
    return with_crc32(read_tokens(spark, path))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir)).drop("copy_key", "class_key")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("n_copies")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(documents(spark, sf_dir)).drop("found")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = shifted_labels(documents(spark, sf_dir, "embeddings"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = documents(spark, sf_dir, "conversations")
    return audited(damaged(conversations), conversations)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256")
    return without_frequent_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", kept)


def queries() -> dict[str, Query]:
    return {
        name: query
        for name, query in globals().items()
        if name.startswith("op") and name[2].isdigit() and callable(query)
    }
