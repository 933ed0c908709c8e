"""Whole scopes as context, and a second retrieval for the questions that the first one left short."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions.text import strip
from docloom.operators.grounding import REGION_CLOSE, REGION_OPEN, evidence_entry
from docloom.operators.stored import stored

#: What a document of its own costs in a request besides its text.
NATIVE_ENVELOPE = 16
#: Tokens of the region around all entries: one token a byte, and one for each tag.
REGION_COST = len(REGION_OPEN) + len(REGION_CLOSE) + 2


def entry_cost(rank: Column, source_id: Column, title: Column, page: Column, body: Column, native: bool = False) -> Column:
    """Tokens, counted as bytes, that one chunk costs as rendered in a prompt, or as a document of its own."""
    if native:
        return F.octet_length(title) + F.octet_length(strip(body)) + NATIVE_ENVELOPE
    return F.octet_length(evidence_entry(rank, source_id, title, page, body)) + 1


def stuff_scopes(chunks: DataFrame, settings: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Which scopes go into the prompt whole instead of being searched, and their chunks in ``order``.

    chunks: scope, source_id, title, page, body and the order's columns;
    settings: scope, threshold (chunks that the model may be stuffed with),
    requested (chunks that were asked for), budget (tokens). A scope goes in
    whole or not at all: it must have at most as many chunks as both allow, and
    cost no more than the budget when rendered. Returns (scope, chunks, cost,
    decision), with a cost where the count allows it, and the stuffed chunks
    with their index. Chunks are counted first, so only scopes of a bounded
    size are ever ordered or rendered.
    """
    counts = chunks.groupBy("scope").agg(F.count("*").alias("chunks"))
    allowed = F.least("threshold", "requested")
    known = stored(settings.join(counts, "scope", "left").select("scope", F.coalesce("chunks", F.lit(0)).alias("chunks"), "budget", allowed.alias("allowed")))
    small = known.where("chunks > 0 AND chunks <= allowed AND budget > 0").select("scope")
    placed = chunks.join(small, "scope", "left_semi").withColumn("index", F.row_number().over(Window.partitionBy("scope").orderBy(*order)))
    priced = stored(placed.withColumn("cost", entry_cost(F.col("index"), F.col("source_id"), F.col("title"), F.col("page"), F.col("body"))))
    costs = priced.groupBy("scope").agg((F.sum("cost") + REGION_COST).alias("cost"))
    decision = (
        F.when(F.col("chunks") == 0, "empty")
        .when(F.col("cost").isNull(), "searched")
        .when(F.col("cost") > F.col("budget"), "over_budget")
        .otherwise("stuffed")
    )
    decided = stored(known.join(costs, "scope", "left").select("scope", "chunks", "cost", decision.alias("decision")))
    return decided, priced.join(decided.where("decision = 'stuffed'").select("scope"), "scope", "left_semi")


def passed(results: DataFrame, questions: DataFrame, corpus: DataFrame, limit: int, enough: int) -> DataFrame:
    """question, selected, parents, sufficient, underfilled of one retrieval pass: enough distinct parents, and fewer rows than the question's scope could give."""
    counts = results.groupBy("question").agg(F.count("*").alias("selected"), F.count_distinct("parent").alias("parents"))
    both = questions.select("question", "scope").join(counts, "question", "left").join(corpus, "scope", "left").fillna(0, ["selected", "parents", "held"])
    return both.select("question", "selected", "parents", (F.col("parents") >= enough).alias("sufficient"), (F.col("selected") < F.least(F.col("held"), F.lit(limit))).alias("underfilled"))


def corrective_retrieval(questions: DataFrame, rewritten: DataFrame, corpus: DataFrame, search: Callable[[DataFrame], DataFrame], limit: int, enough: int) -> tuple[DataFrame, DataFrame]:
    """Retrieve, and retrieve once more for the questions that came back short, asked in other words.

    ``search`` gives (question, chunk_id, parent, score, rank) for questions
    (question, scope, tokens); ``rewritten`` has another wording (question,
    tokens) of those that have one and were not rewritten before; ``corpus``
    (scope, held) counts chunks. Only questions without ``enough`` distinct
    parents run again. The second result counts if it is sufficient or has more
    parents, never by comparing scores, which belong to two different
    questions. Returns the results that count, with ``pass``, and for each
    question: question, selected, parents, sufficient, underfilled, outcome
    (kept, skipped, retried or corrected).
    """
    first = stored(search(questions))
    one = stored(passed(first, questions, corpus, limit, enough))
    short = one.where("NOT sufficient").select("question")
    retried = stored(questions.drop("tokens").join(short, "question", "left_semi").join(rewritten, "question"))
    second = stored(search(retried))
    two = stored(passed(second, retried, corpus, limit, enough))
    both = one.join(two.select("question", F.struct("selected", "parents", "sufficient", "underfilled").alias("again")), "question", "left")
    better = F.col("again").isNotNull() & (F.col("again.sufficient") | (F.col("again.parents") > F.col("parents")))
    outcome = F.when(F.col("sufficient"), "kept").when(F.col("again").isNull(), "skipped").when(better, "corrected").otherwise("retried")
    choose = lambda c: F.when(better, F.col(f"again.{c}")).otherwise(F.col(c)).alias(c)
    turns = stored(both.select("question", *map(choose, ("selected", "parents", "sufficient", "underfilled")), outcome.alias("outcome")))
    corrected = turns.where("outcome = 'corrected'").select("question")
    results = stored(first.join(corrected, "question", "left_anti").withColumn("pass", F.lit(1))).unionByName(stored(second.join(corrected, "question", "left_semi").withColumn("pass", F.lit(2))))
    return results, turns
