"""The evaluation-corpus check over a corpus derived from documents and benchmark items, with planted faults."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from docloom.operators import eval_corpus as E
from docloom.plans.registry import query, table

CATEGORIES = ("factual", "unanswerable", "multi_hop", "conflicting_sources")


def secret_sql(column: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{pattern}')" for pattern in E.SECRETS.values()) + ")"


S14_SQL = rf"""
WITH c AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents),
q AS (SELECT item_id, b.text, doc_id, source, item_id % 4 = 1 AS un FROM benchmark b LEFT JOIN documents ON doc_id = item_id),
j AS (SELECT * FROM q WHERE source IS NOT NULL)
SELECT 'd' || doc_id AS location, 'source_type' AS field, 'unknown type' AS rule FROM documents WHERE doc_id % 31 = 4
UNION ALL SELECT 'd' || doc_id || '-' || pos, 'content', 'empty' FROM c WHERE NOT regexp_matches(content, '\S')
UNION ALL SELECT 'd' || doc_id || '-' || pos, 'span', 'empty or inverted' FROM c WHERE content = ''
UNION ALL SELECT 'd' || doc_id || '-' || pos, 'span', 'misplaced' FROM c WHERE doc_id % 40 = 5 AND pos = 1
UNION ALL SELECT 'd' || doc_id || '-' || pos, 'content', 'secret' FROM c WHERE {secret_sql("content")}
UNION ALL SELECT 'i' || item_id, 'query', 'empty' FROM q WHERE NOT regexp_matches(coalesce(text, ''), '\S')
UNION ALL SELECT 'i' || item_id, 'query', 'secret' FROM q WHERE {secret_sql("text")}
UNION ALL SELECT 'i' || item_id, 'notebook', 'unknown' FROM q WHERE source IS NULL
UNION ALL SELECT 'i' || item_id, 'answerable', 'unanswerable category' FROM j WHERE item_id % 16 = 1
UNION ALL SELECT 'i' || item_id, 'relevant_chunks', 'needs a chunk' FROM j WHERE item_id % 16 = 1
UNION ALL SELECT 'i' || item_id, 'expected_claims', 'needs a claim' FROM j WHERE item_id % 16 = 1 OR item_id % 8 = 0
UNION ALL SELECT 'i' || item_id, 'relevant_chunks', 'needs two chunks' FROM j WHERE item_id % 4 = 2 AND item_id % 3 <> 0
UNION ALL SELECT 'i' || item_id, 'relevant_sources', 'needs two sources' FROM j WHERE item_id % 4 = 3
UNION ALL SELECT 'i' || item_id, 'relevant_chunks', 'unknown' FROM j WHERE NOT un AND item_id % 3 = 0
UNION ALL SELECT 'i' || item_id, 'relevant_sources', 'source not listed' FROM j WHERE NOT un AND item_id % 5 = 2
UNION ALL SELECT 'i' || item_id, 'forbidden_sources', 'own notebook' FROM j WHERE item_id % 7 = 3
UNION ALL SELECT 'i' || item_id, 'forbidden_sources', 'relevant too' FROM j WHERE item_id % 7 = 3 AND item_id % 5 <> 2
UNION ALL SELECT 'i' || item_id, 'expected_claims.answer_markers', 'none' FROM j WHERE NOT un AND item_id % 8 <> 0 AND item_id % 6 = 3
UNION ALL SELECT '<corpus>', 'queries', 'too few' FROM (SELECT count(*) AS n FROM benchmark) WHERE n < 1000
UNION ALL SELECT '<corpus>', 'category ' || k, 'too few' FROM (SELECT k, count(item_id) AS n FROM (SELECT unnest(['factual', 'unanswerable', 'multi_hop', 'conflicting_sources']) AS k, unnest([0, 1, 2, 3]) AS r) LEFT JOIN benchmark ON item_id % 4 = r GROUP BY k) WHERE n < 100
"""


@query("s14_corpus_check", S14_SQL)
def s14(spark, d):
    """Documents are sources, their lines chunks; item n asks about document n. Faults lie at fixed remainders of the ids."""
    docs = table(spark, d, "documents")
    doc = F.concat(F.lit("d"), F.col("doc_id"))
    sources = docs.select(doc.alias("source_id"), F.col("source").alias("notebook_id"), F.when(F.col("doc_id") % 31 == 4, "slides").otherwise("pdf").alias("source_type"))
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("index", "content"))
    ordered = Window.partitionBy("doc_id").orderBy("index")
    size = F.octet_length("content").cast("long")
    moved = F.when((F.col("doc_id") % 40 == 5) & (F.col("index") == 1), 1).otherwise(0)
    start = F.coalesce(F.sum(size + E.SEPARATOR_BYTES).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + moved
    chunks = lines.select(F.concat(doc, F.lit("-"), F.col("index")).alias("chunk_id"), doc.alias("source_id"), "index", "content", start.alias("span_start"), (start + size).alias("span_end"), F.lit(None).cast("string").alias("parent_group"))
    i, none = F.col("item_id"), F.array().cast("array<string>")
    unanswerable, first = i % 4 == 1, F.concat(F.lit("d"), i, F.lit("-0"))
    own = F.concat(F.lit("d"), i)
    claim = F.struct(F.lit("c").alias("id"), F.lit("a claim").alias("text"), F.array(first).alias("supported_by"), F.when(i % 6 == 3, none).otherwise(F.array(F.lit("x"))).alias("markers"))
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question")).join(docs.select(F.col("doc_id").alias("item_id"), F.col("source").alias("notebook_id")), "item_id", "left")
    questions = items.select(
        F.concat(F.lit("i"), i).alias("question_id"), "notebook_id", F.element_at(F.array(*map(F.lit, CATEGORIES)), (i % 4 + 1).cast("int")).alias("category"),
        (~unanswerable | (i % 16 == 1)).alias("answerable"), "question",
        F.when(unanswerable, none).when(i % 3 == 0, F.array(first, F.lit("none"))).otherwise(F.array(first)).alias("relevant_chunks"),
        F.when(i % 5 == 2, none).otherwise(F.array(own)).alias("relevant_sources"), F.when(i % 7 == 3, F.array(own)).alias("forbidden_sources"),
        F.when(~unanswerable & (i % 8 != 0), F.array(claim)).alias("claims"),
    )
    return E.violations(sources, chunks, questions, CATEGORIES, 1000, 100)
