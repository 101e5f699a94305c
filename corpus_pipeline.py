"""Training corpus from raw documents: language, lines, near copies, secrets, packing.

Every stage is one of the training-data operators; its result is written as Parquet in the
shared folder and read again as the documents of the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm.common import documents
from spanmill.llm.language_id import keep_languages
from spanmill.llm.line_dedup import count_names, dedup_lines
from spanmill.llm.near_dedup import drop_near_duplicates
from spanmill.llm.packing import pack_along_curve
from spanmill.llm.secret_scan import mask_secrets
from spanmill.session import written


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return keep_languages(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; those left without any go."""
    cleaned = dedup_lines(docs)
    _, n_repeated, n_near = count_names(docs.columns)
    emptied = (F.col(n_repeated) + F.col(n_near) > 0) & (F.trim(F.col("text")) == "")
    return _measured(cleaned.filter(~F.coalesce(emptied, F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns]))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The earliest document of each group of near copies."""
    return drop_near_duplicates(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced."""
    return _measured(mask_secrets(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 ids."""
    return pack_along_curve(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", fresh_lines),
    ("near_dedup", one_of_each),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: No SQL expresses the network, the near-copy classes and the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
