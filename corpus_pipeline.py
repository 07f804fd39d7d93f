"""The corpus pipeline: five stages over documents, each one written as Parquet and read again by the next.

Quality rules drop bad documents, toxicity drops toxic ones, line deduplication deletes later copies of repeated
runs from the texts, near-deduplication keeps one document of each group, and packing lays the rest into sequences.

All stages take odd rows: null and empty texts, null ids, repeated rows, empty tables, and columns of any further name, which
all stages but the last hand on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import lines, minhash, packing, rules, toxicity
from strataloom.llm.store import delete, new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that break no rule. Null and empty texts have too few words and go; repeated rows stay."""
    return rules.keep_good(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5, learned from the labels of rows that are here. Null and empty texts score as texts without a match."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without later copies of repeated runs in their texts; n_chars is counted anew. Null texts stay null."""
    return lines.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group. Rows of equal ids stay together; null ids and texts without words stay."""
    return minhash.keep_firsts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their places in sequences; null and empty texts are the end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality rules", quality), ("toxicity", toxic), ("line dedup", line_dedup), ("near dedup", near_dedup), ("packing", pack)]
#: Tokenizing, learned weights and packing aren't expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's folder is deleted when the next one is written; the last one stays, as the result may read it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
