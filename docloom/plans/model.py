"""The engine's tables, derived from the test tables.

notebooks come from the sources of documents, generations are two for each
document, chunks are lines, parents are runs of four lines. MODEL_SQL holds the
same definitions for the oracle, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.plans.registry import table

START = "TIMESTAMP '2024-01-01 00:00:00'"


def notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("notebook_id"), (F.expr("CAST(substr(source, 4) AS INT)") % 4).alias("owner")).distinct()


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("lines"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    state = F.when((F.col("doc_id") + F.col("n")) % 5 == 0, "failed").when((F.col("n") == 2) & (F.col("doc_id") % 6 == 1), "building").otherwise("published")
    return docs.select(
        F.concat(F.lit("g"), F.col("doc_id"), F.lit("-"), F.col("n")).alias("generation_id"),
        F.col("doc_id").alias("source_id"),
        state.alias("state"),
        F.concat(F.lit("emb:v"), F.when((F.col("doc_id") % 3 == 0) & (F.col("n") == 1), 0).otherwise(1)).alias("fingerprint"),
        F.expr(f"{START} + make_interval(0, 0, 0, CAST(n AS INT), CAST(doc_id % 500 AS INT), 0, 0)").alias("created_at"),
        (F.col("lines") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).cast("bigint").alias("expected_chunks"),
    )


def active(gens: DataFrame) -> DataFrame:
    """(source_id, active_generation_id): the newest published generation of each source."""
    newest = F.max_by("generation_id", F.struct("created_at", "generation_id"))
    return gens.where("state = 'published'").groupBy("source_id").agg(newest.alias("active_generation_id"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 7 == 0, "error").when(F.col("doc_id") % 7 == 1, "processing").otherwise("ready")
    kind = F.element_at(F.array(*map(F.lit, ("text", "pdf", "web", "youtube"))), (F.col("doc_id") % 4 + 1).cast("int"))
    own = docs.select(F.col("doc_id").alias("source_id"), F.col("source").alias("notebook_id"), status.alias("status"), kind.alias("kind"))
    return own.join(active(generations(spark, sf_dir)), "source_id", "left")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of both generations of every document; the first generation has shorter lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"), F.lit(0).alias("_")).drop("_")
    both = lines.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    return both.select(
        F.concat(F.lit("g"), F.col("doc_id"), F.lit("-"), F.col("n")).alias("generation_id"),
        F.col("doc_id").alias("source_id"),
        F.col("pos").cast("bigint").alias("chunk_index"),
        F.floor(F.col("pos") / 4).cast("bigint").alias("parent"),
        F.when((F.col("n") == 1) & (F.col("pos") % 3 == 0), F.substring("line", 1, 20)).otherwise(F.col("line")).alias("content"),
    )


MODEL_SQL = f"""
notebooks AS (SELECT DISTINCT source AS notebook_id, CAST(substr(source, 4) AS INT) % 4 AS owner FROM documents),
gens AS (SELECT 'g' || doc_id || '-' || n AS generation_id, doc_id AS source_id,
  CASE WHEN (doc_id + n) % 5 = 0 THEN 'failed' WHEN n = 2 AND doc_id % 6 = 1 THEN 'building' ELSE 'published' END AS state,
  'emb:v' || CASE WHEN doc_id % 3 = 0 AND n = 1 THEN 0 ELSE 1 END AS fingerprint,
  {START} + to_days(CAST(n AS INT)) + to_hours(doc_id % 500) AS created_at,
  CAST(len(string_split(text, chr(10))) + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS expected_chunks
  FROM documents, (SELECT unnest([1, 2]) AS n)),
act AS (SELECT source_id, max_by(generation_id, (created_at, generation_id)) AS active_generation_id FROM gens WHERE state = 'published' GROUP BY source_id),
srcs AS (SELECT doc_id AS source_id, source AS notebook_id, CASE WHEN doc_id % 7 = 0 THEN 'error' WHEN doc_id % 7 = 1 THEN 'processing' ELSE 'ready' END AS status,
  ['text', 'pdf', 'web', 'youtube'][CAST(doc_id % 4 + 1 AS INT)] AS kind, active_generation_id FROM documents LEFT JOIN act ON source_id = doc_id),
chunks AS (SELECT 'g' || doc_id || '-' || n AS generation_id, doc_id AS source_id, pos AS chunk_index, pos // 4 AS parent,
  CASE WHEN n = 1 AND pos % 3 = 0 THEN substr(line, 1, 20) ELSE line END AS content
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents), (SELECT unnest([1, 2]) AS n))
"""
