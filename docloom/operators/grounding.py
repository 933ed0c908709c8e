"""Whether the citations of an answer hold: markers joined with context, pointers and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import citations as C
from docloom.functions.claims import code_ranges, holds, let, statement, supported
from docloom.functions.text import strip, xml_escape


def verify_citations(answers: DataFrame, context: DataFrame, active: DataFrame) -> DataFrame:
    """One row for each marker outside of code: answer_id, pos, n, reason.

    ``context`` (answer_id, n, source_id, generation_id, content, owned) numbers
    the chunks of each answer from 1, owned where their provenance can be
    theirs (``claims.owns_chunk``); ``active`` has (source_id,
    active_generation_id). The first rule that a marker breaks is its reason, in
    this order: missing_chunk, no_generation, stale, unowned, unsupported; then
    duplicate (neither cited nor rejected) and cited. An answer without markers
    has no row; a null answer counts as empty.
    """
    found = answers.select("answer_id", F.posexplode(C.located_markers(F.coalesce("answer", F.lit("")))).alias("pos", "mark")).select("answer_id", "pos", "mark.*")
    marks = found.groupBy("answer_id", "n").agg(F.collect_list(F.struct("pos", "claim")).alias("marks"))  # of one answer
    broken = (
        F.when(F.col("source_id").isNull(), "missing_chunk")
        .when(F.col("generation_id").isNull(), "no_generation")
        .when(~F.col("generation_id").eqNullSafe(F.col("active_generation_id")), "stale")
        .when(~F.coalesce("owned", F.lit(False)), "unowned")
    )
    held = marks.join(context.join(active, "source_id", "left"), ["answer_id", "n"], "left").withColumn("broken", broken)
    unsupported = lambda m, base: F.when(~F.coalesce(holds(statement(m["claim"]), base), F.lit(False)), "unsupported")
    reasons = let(F.when(F.col("broken").isNull(), statement(F.col("content"))), lambda base: F.transform("marks", lambda m: F.struct(m["pos"].alias("pos"), F.coalesce("broken", unsupported(m, base)).alias("broken"))))
    judged = held.select("answer_id", "n", F.inline(reasons))
    earlier = Window.partitionBy("answer_id", "n", F.col("broken").isNull()).orderBy("pos")
    kept = F.when(F.row_number().over(earlier) > 1, "duplicate").otherwise("cited")
    return judged.select("answer_id", "pos", "n", F.coalesce("broken", kept).alias("reason"))


def citation_summary(answers: DataFrame, verified: DataFrame) -> DataFrame:
    """answer_id, cited, rejected (markers in code included), abstained of every answer."""
    counts = verified.groupBy("answer_id").agg(F.count_if(F.col("reason") == "cited").alias("cited"), F.count_if(F.col("reason") == "duplicate").alias("again"))
    marks = F.regexp_count("answer", F.lit(C.MARK)).cast("bigint")
    both = answers.select("answer_id", F.coalesce(marks, F.lit(0)).alias("marks"), C.abstains(F.col("answer")).alias("abstained")).join(counts, "answer_id", "left").fillna(0, ["cited", "again"])
    return both.select("answer_id", "cited", (F.col("marks") - F.col("cited") - F.col("again")).alias("rejected"), "abstained")


#: The tags around a region of evidence.
REGION_OPEN, REGION_CLOSE = "<untrusted_source_data>", "</untrusted_source_data>"


def evidence_entry(rank: Column, source_id: Column, title: Column, page: Column, body: Column) -> Column:
    """One escaped source element."""
    place = F.when(page.isNotNull(), F.concat(F.lit(' page="'), page, F.lit('"'))).otherwise("")
    return F.concat(
        F.lit('<source index="'), rank, F.lit('" source_id="'), xml_escape(source_id.cast("string")), F.lit('" title="'), xml_escape(title), F.lit('"'), place,
        F.lit(">\n<content>\n"), xml_escape(strip(body)), F.lit("\n</content>\n</source>\n\n"),
    )


def evidence(rows: DataFrame, key: str) -> DataFrame:
    """key, evidence: the results (rank, source_id, title, page, body) of each key as one escaped region, in rank order.

    The results of a key are a retrieval's top k, so its text is bounded.
    """
    entry = evidence_entry(F.col("rank"), F.col("source_id"), F.col("title"), F.col("page"), F.col("body"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return rows.groupBy(key).agg(F.concat(F.lit(f"{REGION_OPEN}\n"), F.array_join(ordered["entry"], ""), F.lit(REGION_CLOSE)).alias("evidence"))


def page_lookup(pages: DataFrame, offsets: DataFrame, key: str) -> DataFrame:
    """key, offset, page: the last page that starts at or before each offset, 1 if none does.

    One window over both tables' rows in the order of offsets: no range join.
    """
    both = pages.select(key, F.col("start").alias("at"), "page", F.lit(0).alias("asks")).unionByName(offsets.select(key, F.col("offset").alias("at"), F.lit(None).cast(pages.schema["page"].dataType).alias("page"), F.lit(1).alias("asks")))
    before = Window.partitionBy(key).orderBy("at", "asks", "page").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("found", F.last("page", ignorenulls=True).over(before)).where("asks = 1")
    return found.select(key, F.col("at").alias("offset"), F.coalesce("found", F.lit(1)).cast("bigint").alias("page"))


def time_range(text: Column) -> Column:
    """struct<first, last>: the smallest and largest start in seconds of lines that begin with [minutes:seconds]; nulls without any."""
    line = r"(?m)^\s*\[\s*([0-9.]+)\s*:\s*([0-9.]+)\s*\]"
    parts = F.zip_with(F.regexp_extract_all(text, F.lit(line), 1), F.regexp_extract_all(text, F.lit(line), 2), lambda m, s: m.try_cast("double") * 60 + s.try_cast("double"))
    return F.struct(F.array_min(parts).alias("first"), F.array_max(parts).alias("last"))


def mean_relevance(domain: Column, score: Column, scales: tuple[str, ...] = ("dense", "reranker")) -> Column:
    """The mean score of a group whose scores lie on a relevance scale, else null; an aggregate."""
    return F.avg(F.when(domain.isin(*scales), score))


def resolve_native(answers: DataFrame, native: DataFrame, documents: DataFrame, context: DataFrame, active: DataFrame) -> DataFrame:
    """What becomes of each citation that a provider made itself: answer_id, pos, document_index, number, reason.

    ``native`` (answer_id, pos, document_index, cited_text, marker_start in
    characters) names documents by their place in ``documents`` (answer_id,
    document_index, source_id, generation_id, chunk_index, metadata), of which
    ``context`` has what was retrieved in the same place, with content and
    ``owned``. A citation is refused, in this order, as missing (no such
    document), not_quoted (another chunk, or a text that the chunk does not
    hold), unlinked (the claim before the marker is not supported by the quote),
    in_code, or unowned (metadata other than the chunk's, so also a shifted
    span of the same width). Of those left the first of a document counts, the
    others are ``repeated``; it is ``stale`` unless its generation is active,
    else cited. Documents are numbered by their first citation, from 1.
    """
    key = ["answer_id", "document_index"]
    held = context.select(*key, *[F.col(c).alias(f"chunk_{c}") for c in ("source_id", "generation_id", "chunk_index", "content", "metadata", "owned")])
    first = native.join(documents.select(*key), key).groupBy(*key).agg(F.min("pos").alias("first"))
    numbers = first.withColumn("number", F.row_number().over(Window.partitionBy("answer_id").orderBy("first")))
    all_ = native.join(answers, "answer_id").join(documents, key, "left").join(held, key, "left").join(numbers.select(*key, "number"), key, "left").join(active, "source_id", "left")
    same = (F.col("source_id") == F.col("chunk_source_id")) & (F.col("generation_id") == F.col("chunk_generation_id")) & (F.col("chunk_index") == F.col("chunk_chunk_index"))
    quote = strip(F.col("cited_text"))
    before = F.left("answer", F.col("marker_start"))
    in_code = F.exists(code_ranges(F.col("answer")), lambda r: (F.octet_length(before) >= r["start"]) & (F.octet_length(before) < r["stop"]))
    no = lambda condition: ~F.coalesce(condition, F.lit(False))
    broken = (
        F.when(F.col("source_id").isNull(), "missing")
        .when(no(same & (quote != "") & F.contains("chunk_content", quote)), "not_quoted")
        .when(no(supported(C.preceding_claim(before), F.col("cited_text"))), "unlinked")
        .when(in_code, "in_code")
        .when(no(F.col("chunk_owned") & F.col("metadata").eqNullSafe(F.col("chunk_metadata"))), "unowned")
    )
    judged = all_.withColumn("broken", broken)
    again = F.row_number().over(Window.partitionBy(*key, F.col("broken").isNull()).orderBy("pos")) > 1
    left = F.when(again, "repeated").when(no(F.col("generation_id") == F.col("active_generation_id")), "stale").otherwise("cited")
    return judged.select("answer_id", "pos", "document_index", "number", F.coalesce("broken", left).alias("reason"))
