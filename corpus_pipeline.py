"""A training-data pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept, as a DataFrame with the columns of
documents, and returns what it keeps; the last returns token counts and digests.
Stages are written as Parquet and read again by the next one, so a lost
executor or a restart costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm import bpe_codec, decontaminate, line_dedup, near_dedup, quality_mil
from docloom.llm.common import drop_path, materialize, shared_dir, table, unused


def columns(docs: DataFrame) -> list:
    """The columns of a table, by their names whatever these hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects.

    It learns from the labelled rows of the fold that op10 learns from, in the
    whole documents table. Rows with null or empty texts are scored like others.
    """
    model = quality_mil.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), use=quality_mil.fold(F.col("id"), 3) != 1)
    body, score = unused("body"), unused("score")
    scored = quality_mil.score_quality(docs.withColumn(body, F.col("text")), model, text_col=body, keep_text=False, score_col=score)
    return scored.where(F.col(score) >= 0.5).select(*columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines within one word of an earlier line, and exact repeats of any line; n_chars follows the text. A document of which no word is left goes."""
    n_lines, n_removed = unused("lines"), unused("removed")
    out = line_dedup.dedup_lines(docs, made=(n_lines, n_removed))
    left = out.where((F.col(n_removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component of near duplicates.

    Rows of equal id stay or go together; rows without an id stay.
    """
    key = unused("id")
    gone = near_dedup.near_duplicates(docs.select("doc_id", "text")).where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark windows cover a twentieth of the words or more; null and empty texts stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of the ids and of their decoding; a null text counts as empty, repeated rows each get their own."""
    return bpe_codec.digest_documents(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe_codec", encode_and_decode),
]
#: A trained model and a byte-pair encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    A stage's table goes when the next one is written; the last one stays for
    the reader of the result. Empty documents give an empty result, and null
    texts pass through the stages as their docstrings say.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_dir(spark)
        docs = materialize(stage(spark, docs, sf_dir), path)
        if before:
            drop_path(spark, before)
        before = path
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
