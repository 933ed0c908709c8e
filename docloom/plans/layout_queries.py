"""Page layout and chunking by source type over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.functions.chunking import MARKDOWN_TYPES, chunk_sources
from docloom.functions.layout import page_layouts, page_starts, span_pages
from docloom.plans.registry import query, table
from docloom.plans.text_queries import COMPACT, UNIX

KINDS = ("pdf", "markdown", "text", "docx")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Runs of six lines are pages; every fifth page is blank."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    runs = lines.groupBy("doc_id", F.floor(F.col("pos") / 6).alias("page")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return runs.select("doc_id", F.col("page").cast("long").alias("page"), F.when(F.col("page") % 5 == 3, " \n").otherwise(text).alias("text"))


PAGES_SQL = f"""
p AS (SELECT doc_id, pos // 6 AS page, CASE WHEN pos // 6 % 5 = 3 THEN ' ' || chr(10) ELSE string_agg(line, chr(10) ORDER BY pos) END AS x FROM
 (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents) GROUP BY doc_id, pos // 6),
b AS (SELECT doc_id, page, strlen({COMPACT.format(UNIX)}) AS bytes FROM p),
w AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
s AS (SELECT doc_id, page, CAST(bytes AS BIGINT) AS bytes, CAST(before + 2 * sum(CASE WHEN before > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) AS page_start FROM w)
"""


@query("i1_page_layout", f"WITH {PAGES_SQL} SELECT doc_id, page, page_start, bytes FROM s")
def i1(spark, d):
    return page_starts(pages(spark, d)).select("doc_id", "page", "page_start", "bytes")


@query("i1_span_pages", f"""
WITH {PAGES_SQL}, spans AS (SELECT doc_id, total, unnest(range(0, total, 400)) AS a FROM (SELECT doc_id, max(page_start + bytes) AS total FROM s GROUP BY doc_id))
SELECT doc_id, a AS span_start, greatest(1, count(*) FILTER (page_start <= a)) AS first_page, greatest(1, count(*) FILTER (page_start <= least(a + 400, total) - 1)) AS last_page
FROM spans JOIN s USING (doc_id) GROUP BY doc_id, a, total""")
def i1_spans(spark, d):
    """The pages that each run of 400 bytes of the joined text covers."""
    layouts = page_layouts(pages(spark, d)).withColumn("total", F.octet_length("text").cast("long")).where("total > 0")
    spans = layouts.select("doc_id", "page_starts", "total", F.explode(F.expr("sequence(0L, total - 1, 400L)")).alias("span_start"))
    first, last = span_pages(F.col("page_starts"), F.col("span_start"), F.least(F.col("span_start") + 400, F.col("total")))
    return spans.select("doc_id", "span_start", first.cast("long").alias("first_page"), last.cast("long").alias("last_page"))


def kind() -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))


@query("i2_source_chunks")
def i2(spark, d):
    """Parents and children of every document by its source type, with pages where the type has some."""
    layouts = page_layouts(pages(spark, d), markdown=kind().isin(*MARKDOWN_TYPES))
    return chunk_sources(layouts.withColumn("kind", kind()).withColumn("paginated", F.col("kind") == "pdf"))
