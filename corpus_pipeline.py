"""A training corpus in five stages, each on what the one before kept: quality rules, near-duplicates, repeated passages, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.near import keep_one
from tidemark.llm.packing import pack, pieces
from tidemark.llm.passages import remove_passages
from tidemark.llm.quality import judge
from tidemark.llm.secrets import redact
from tidemark.llm.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs in the columns of like, n_chars as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)).select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose posterior is good."""
    return judge(docs).where("quality.kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the least id."""
    return keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occurred before; those of which nothing is left go."""
    return _counted(remove_passages(docs).where("removed IS NULL OR text <> ''"), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return _counted(redact(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False).drop("ids"))


STAGES: list[tuple[str, Stage]] = [("quality rules", quality), ("near duplicates", near_duplicates), ("substring dedup", passages), ("secret scans", secrets), ("packing", packing)]
#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
