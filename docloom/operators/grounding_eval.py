"""Grounding evaluation: do answers assert the expected claims, and do their citations carry them?

Everything is decided by literal markers, never by a model. A citation belongs
to at most one claim: the one that the text between it and the citation before
asserts. Citations that follow each other with nothing but blanks and
punctuation between are a run and share the claim of the last one that has one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import citations as C

#: Verdicts on citations and classes of cases.
VERDICTS = ["correct", "unknown_chunk", "stale_generation", "cross_notebook", "span_mismatch", "unrelated_to_claim", "malformed_marker"]
CLASSES = ["ok", "provider_error", "missing_abstention", "spurious_abstention", "uncited", "malformed_citation", "unknown_query"]
#: White space and ASCII punctuation.
FILLER = r"^[\s!-/:-@\[-`{-~]*$"


def asserts(text: Column, markers: Column) -> Column:
    """Whether a text holds all markers of a claim, in any case; never without markers."""
    low = F.lower(text)
    return F.coalesce((F.size(markers) > 0) & F.forall(markers, lambda m: F.contains(low, F.lower(m))), F.lit(False))


def read_cases(cases: DataFrame, queries: DataFrame) -> DataFrame:
    """``cases`` with what is known of their query, ``abstained``, ``expected`` (whether abstaining is right) and ``failed``."""
    known = cases.join(queries, "query_id", "left")
    failed = F.col("outcome") == "provider_error"
    abstained = (F.col("outcome") == "abstained") | (~failed & C.abstains(F.col("answer")))
    return known.select("*", failed.alias("failed"), F.when(F.col("notebook").isNull(), False).otherwise(abstained).alias("abstained"), (~F.col("answerable") | ~F.col("evidence_sufficient")).alias("expected"))


def associate(cases: DataFrame, claims: DataFrame, citations: DataFrame) -> DataFrame:
    """``citations`` (query_id, pos, start, stop of their markers) with the claim_id each belongs to, or null.

    ``claims`` are those that the answers assert. A citation owns the text since
    the end of the marker before it; more than one claim in it is none.
    """
    order = Window.partitionBy("query_id").orderBy("pos")
    placed = citations.join(cases.select("query_id", "answer"), "query_id").withColumn("since", F.coalesce(F.lag("stop").over(order), F.lit(0)))
    local = placed.withColumn("local", F.substring("answer", F.col("since") + 1, F.col("start") - F.col("since")))
    held = local.select("query_id", "pos", "local").join(claims.select("query_id", "claim_id", "markers"), "query_id").where(asserts(F.col("local"), F.col("markers")))
    direct = held.groupBy("query_id", "pos").agg(F.count("*").alias("n"), F.min("claim_id").alias("direct")).where("n = 1").select("query_id", "pos", "direct")
    continues = (F.lag("stop").over(order).isNotNull()) & F.col("local").rlike(FILLER)
    runs = local.withColumn("run", F.sum(F.when(continues, 0).otherwise(1)).over(order)).join(direct, ["query_id", "pos"], "left")
    in_run = Window.partitionBy("query_id", "run").orderBy("pos")
    return runs.withColumn("claim_id", F.last("direct", ignorenulls=True).over(in_run)).drop("answer", "since", "local", "run", "direct")


def judge(cases: DataFrame, claims: DataFrame, chunks: DataFrame, associated: DataFrame, generation: str) -> DataFrame:
    """``associated`` with a verdict: the first condition that a citation (source_id, chunk_index, quote) breaks.

    ``chunks`` has chunk_id, source_id, chunk_index, notebook (as chunk_notebook)
    and content; a quote may end in an ellipsis and must be part of its chunk.
    """
    found = associated.join(chunks, ["source_id", "chunk_index"], "left").join(cases.select("query_id", "notebook", "generations"), "query_id").join(claims.select("query_id", "claim_id", "supported_by"), ["query_id", "claim_id"], "left")
    quote = F.trim(F.regexp_replace(F.trim("quote"), r"\.+$", ""))
    verdict = (
        F.when(F.col("chunk_id").isNull(), "unknown_chunk")
        .when(~F.array_contains("generations", generation), "stale_generation")
        .when(F.col("chunk_notebook") != F.col("notebook"), "cross_notebook")
        .when((quote != "") & ~F.contains("content", quote), "span_mismatch")
        .when(~F.coalesce(F.array_contains("supported_by", F.col("chunk_id")), F.lit(False)), "unrelated_to_claim")
        .otherwise("correct")
    )
    return found.select("query_id", "pos", "claim_id", verdict.alias("verdict"))


def evaluate(queries: DataFrame, claims: DataFrame, cases: DataFrame, citations: DataFrame, chunks: DataFrame, generation: str) -> DataFrame:
    """One row a case: its class, its counts of claims and citations, a count for each verdict, and whether abstaining was right.

    ``queries``: query_id, category, split, answerable, notebook; ``claims``:
    query_id, claim_id, markers, supported_by; ``cases``: query_id, outcome
    (answered, abstained or provider_error), answer, rejected (markers that
    resolved to nothing), generations, evidence_sufficient. A case whose query
    is not known keeps its place with the class unknown_query and no counts.
    """
    read = read_cases(cases, queries)
    live = read.where("notebook IS NOT NULL AND NOT failed AND NOT abstained AND outcome = 'answered'")
    asserted = claims.join(live.select("query_id", "answer"), "query_id").where(asserts(F.col("answer"), F.col("markers"))).drop("answer")
    judged = judge(live, claims, chunks, associate(live, asserted, citations), generation)
    of_case = judged.groupBy("query_id").agg(F.count("*").alias("cited"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS[:-1]], F.count_distinct(F.when(F.col("verdict") == "correct", F.col("claim_id"))).alias("supported"))
    expected = claims.groupBy("query_id").agg(F.count("*").alias("expected_claims"))
    made = asserted.groupBy("query_id").agg(F.count("*").alias("asserted_claims"))
    all_ = read.join(of_case, "query_id", "left").join(expected, "query_id", "left").join(made, "query_id", "left").fillna(0, ["cited", "supported", "expected_claims", "asserted_claims", *VERDICTS[:-1]])
    known, answered = F.col("notebook").isNotNull(), F.col("outcome") == "answered"
    rejected = F.when(known & answered, F.col("rejected")).otherwise(0)
    kind = (
        F.when(~known, "unknown_query")
        .when(F.col("failed"), "provider_error")
        .when(rejected > 0, "malformed_citation")
        .when(F.col("abstained") & ~F.col("expected"), "spurious_abstention")
        .when(~F.col("abstained") & F.col("expected"), "missing_abstention")
        .when(~F.col("abstained") & (F.col("cited") == 0), "uncited")
        .otherwise("ok")
    )
    return all_.select(
        "query_id", F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("split", F.lit("unknown")).alias("split"), kind.alias("class"),
        F.when(known, F.col("expected_claims")).otherwise(0).alias("expected_claims"), "asserted_claims", F.col("supported").alias("supported_claims"),
        (F.col("asserted_claims") - F.col("supported")).alias("unsupported_claims"), (F.col("cited") + rejected).alias("citations"), *VERDICTS[:-1], rejected.cast("bigint").alias("malformed_marker"),
        "abstained", F.coalesce(known & ~F.col("failed") & (F.col("abstained") == F.col("expected")), F.lit(False)).alias("abstention_correct"),
    )


def report(outcomes: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """Metrics of all cases (``by`` columns null) and of each group of them; a ratio without anything to measure is 0.

    Ratios are rounded to six places; verdicts and classes are counted in columns of their names.
    """
    ratio = lambda part, whole: F.when(whole > 0, F.round(part / whole, 6)).otherwise(0.0)
    s = lambda c: F.sum(c)
    return outcomes.rollup(*by).agg(
        F.count("*").alias("cases"),
        ratio(s("asserted_claims"), s("expected_claims")).alias("expected_claim_coverage"),
        ratio(s("correct"), s("citations")).alias("citation_precision"),
        ratio(s("supported_claims"), s("asserted_claims")).alias("citation_coverage"),
        ratio(F.count_if("abstention_correct"), F.count("*")).alias("abstention_accuracy"),
        s("unsupported_claims").alias("unsupported_claims"),
        s("citations").alias("citations"),
        *[s(v).alias(v) for v in VERDICTS],
        *[F.count_if(F.col("class") == c).alias(f"class_{c}") for c in CLASSES],
    )
