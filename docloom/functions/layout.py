"""Cleaned pages joined to one text, with the byte at which each page begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions.text import markdown_clean, plain_clean

#: Fixed value: what stands between two pages.
SEPARATOR = "\n\n"


def page_starts(pages: DataFrame, key: str = "doc_id", markdown: Column | bool = False) -> DataFrame:
    """``pages`` (key, page, text) with clean, its bytes, and page_start in the joined text.

    Pages are cleaned one by one, so that joining moves no byte. Empty and null
    pages keep their numbers; a separator is written only once some text is there.
    """
    dirty = F.coalesce("text", F.lit(""))
    clean = F.when(markdown if isinstance(markdown, Column) else F.lit(markdown), markdown_clean(dirty)).otherwise(plain_clean(dirty))
    ordered = Window.partitionBy(key).orderBy("page")
    before = F.coalesce(F.sum("bytes").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = pages.withColumn("clean", clean).withColumn("bytes", F.octet_length("clean").cast("long")).withColumn("before", before)
    breaks = F.sum((F.col("before") > 0).cast("long")).over(ordered)
    return sized.withColumn("page_start", F.col("before") + len(SEPARATOR) * breaks).drop("before")


def page_layouts(pages: DataFrame, key: str = "doc_id", markdown: Column | bool = False) -> DataFrame:
    """key, text (the cleaned pages joined) and page_starts of every source; one row holds one source's pages, never more."""
    held = page_starts(pages, key, markdown).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "page_start", "bytes", "clean"))).alias("p"))
    parts = F.transform("p", lambda x: F.concat(F.when(x["page_start"] > 0, SEPARATOR).otherwise(""), x["clean"]))
    return held.select(key, F.array_join(parts, "").alias("text"), F.transform("p", lambda x: x["page_start"]).alias("page_starts"))


def span_pages(starts: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The first and the last page, from 1, that a byte span covers; its end is exclusive."""
    page = lambda at: F.greatest(F.lit(1), F.size(F.filter(starts, lambda s: s <= at)))
    return page(start), page(F.greatest(end - 1, start))
