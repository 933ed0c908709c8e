"""One retrieval for questions of different modes: validation, routing, reranking, and a trace that holds no text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from docloom.functions.text import lexical_tokens, strip
from docloom.operators import retrieval as R
from docloom.operators.stored import join_small, stored

MODES = ("hybrid", "dense", "lexical")
MAX_LIMIT = 500
#: Score scales by the mode that ordered the rows.
DOMAINS = {"hybrid": "rrf_rank", "dense": "dense_similarity", "lexical": "lexical_rank"}
RERANKED = "reranker_relevance"
STAGES = ("dense", "lexical", "fused", "deduplicated", "reranker_input", "reranker_output", "selected")
# Reason codes of a retrieval, in the order in which a trace lists them.
REASONS = ("ok", "empty_corpus", "no_candidates", "underfilled_top_k", "reranker_absent", "reranker_failed", "dedup_shortfall", "evidence_dropped_for_budget")

#: Gives question, chunk_id, relevance for pairs (question, chunk_id, asked, tokens).
Scorer = Callable[[DataFrame], DataFrame]


def route(questions: DataFrame, hybrid_enabled: str = "true") -> DataFrame:
    """``questions`` with error, mode (null for what cannot be asked) and requested within its limits.

    A text without a visible character is ``empty_query``, a mode that is none of
    MODES ``unknown_mode``. Hybrid questions become dense ones where hybrid
    search is off, by a condition over a question's columns; other modes stay.
    """
    blank = F.coalesce(strip(F.col("text")), F.lit("")) == ""
    known = F.coalesce(F.col("mode").isin(*MODES), F.lit(False))
    error = F.when(blank, "empty_query").when(~known, "unknown_mode")
    mode = F.when((F.col("mode") == "hybrid") & ~F.expr(hybrid_enabled), "dense").otherwise(F.col("mode"))
    return (
        questions.withColumn("error", error)
        .withColumn("mode", F.when(F.col("error").isNull(), mode))
        .withColumn("requested", F.least(F.greatest(F.coalesce("requested", F.lit(1)), F.lit(1)), F.lit(MAX_LIMIT)))
    )


def routed_search(chunks: DataFrame, routed: DataFrame, pool: int, texts: DataFrame | None = None, placed: R.Placed | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The candidates of each question in its own mode, and both rankings they come from: each (question, chunk_id, score, rank).

    chunks: chunk_id, scope, embedding, tokens; routed: what ``route`` gives of
    (question, scope, text, tokens, embedding, mode, requested, min_relevance,
    lexical_ok). Each ranking is computed once for all modes that need it. Dense
    and lexical questions keep the order of their ranking, hybrid ones are fused
    by rank; the lexical mode asks for all words. Where the lexical ranking is
    not to be had, a hybrid question is fused from the dense one alone and a
    lexical one has no candidate. The least relevance is one of the score that
    orders the rows, which ``domain`` of the candidates names. ``texts``
    (chunk_id, text) may stand for the tokens, with ``placed`` as in ``lexical_topk``.
    """
    modes = routed.where("mode IS NOT NULL").select("question", "mode", F.coalesce("min_relevance", F.lit(0.0)).alias("least"))
    near_asked = routed.where("mode IN ('dense', 'hybrid') AND embedding IS NOT NULL")
    said_asked = routed.where("mode IN ('lexical', 'hybrid') AND lexical_ok AND size(tokens) > 0")
    near = stored(R.dense_topk(chunks.where("embedding IS NOT NULL"), near_asked, pool))
    said = stored(R.lexical_topk(chunks if texts is None else texts.select("chunk_id", lexical_tokens(F.col("text")).alias("tokens")), said_asked.withColumn("strict", F.col("mode") == "lexical"), pool, placed=placed))
    of = lambda ranked, mode: ranked.join(modes.where(F.col("mode") == mode).select("question"), "question", "left_semi")
    fused = R.fuse(of(near, "hybrid"), of(said, "hybrid"), 2 * pool)
    named = lambda rows, mode: rows.select("question", "chunk_id", "score", "rank", F.lit(DOMAINS[mode]).alias("domain"))
    found = named(fused, "hybrid").union(named(of(near, "dense"), "dense")).union(named(of(said, "lexical"), "lexical"))
    kept = found.join(modes.select("question", "least"), "question").where("score >= least").drop("least")
    return stored(kept), near, said


def word_overlap(pairs: DataFrame) -> DataFrame:
    """A reranker without a model: the share of a question's distinct words that a chunk has."""
    asked = F.array_distinct("asked")
    share = F.size(F.array_intersect(asked, F.col("tokens"))) / F.greatest(F.size(asked), F.lit(1))
    return pairs.select("question", "chunk_id", F.round(share, 6).alias("relevance"))


def rerank(candidates: DataFrame, routed: DataFrame, chunks: DataFrame, scorer: Scorer | None, least_chunks: int, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(question, chunk_id, parent, score, rank, domain) by the reranker's relevance, and (question, reranker_input, reranker_output, reason).

    The whole pool is scored, not the part that would be selected, and by the
    chunk's own words. Questions whose scope has fewer than ``least_chunks``
    chunks are left as they are. Without a scorer, or where it gives a question
    no finite relevance, the former order stays and the reason says so; else
    pairs without a finite relevance go, the highest relevance of a pair counts,
    and ties are broken by id. Texts, of ``texts`` or else of ``chunks``, are read
    and cut into words only for chunks in some pool.
    """
    held = chunks.groupBy("scope").agg(F.count("*").alias("held"))
    large = routed.join(held, "scope").where(F.col("held") >= least_chunks).select("question", F.col("tokens").alias("asked"))
    ready = stored(candidates.join(large.select("question"), "question", "left_semi"))
    sizes = ready.groupBy("question").agg(F.count("*").alias("reranker_input"))
    if scorer is None:
        return candidates, sizes.select("question", F.lit(0).cast("bigint").alias("reranker_input"), F.lit(0).cast("bigint").alias("reranker_output"), F.lit("reranker_absent").alias("reason"))
    wanted = stored(ready.select("chunk_id").distinct())
    own = chunks.select("chunk_id", "tokens") if texts is None else texts.select("chunk_id", "text")
    pooled = join_small(own, wanted, ["chunk_id"], "chunk_id", 1, "left_semi")
    pooled = stored(pooled if texts is None else pooled.select("chunk_id", lexical_tokens(F.col("text")).alias("tokens")))
    pairs = ready.select("question", "chunk_id").join(large, "question").join(pooled, "chunk_id").select("question", "chunk_id", "asked", "tokens")
    relevance = F.col("relevance").cast("double")
    finite = relevance.isNotNull() & ~F.isnan(relevance) & (F.abs(relevance) < float("inf"))
    judged = scorer(pairs).where(finite).groupBy("question", "chunk_id").agg(F.max(relevance).alias("relevance"))
    ranked = ready.join(judged, ["question", "chunk_id"]).select("question", "chunk_id", "parent", F.col("relevance").alias("score"), F.lit(RERANKED).alias("domain"))
    ranked = stored(ranked.withColumn("rank", F.row_number().over(R.total_order())).select(*candidates.columns))
    outputs = ranked.groupBy("question").agg(F.count("*").alias("reranker_output"))
    stages = stored(
        sizes.join(outputs, "question", "left").select("question", "reranker_input", F.coalesce("reranker_output", F.lit(0)).alias("reranker_output"), F.when(F.col("reranker_output").isNull(), "reranker_failed").alias("reason"))
    )
    return candidates.join(ranked.select("question").distinct(), "question", "left_anti").unionByName(ranked), stages


def traced_retrieval(chunks: DataFrame, questions: DataFrame, pool: int, scorer: Scorer | None, least_chunks: int, hybrid_enabled: str = "true", texts: DataFrame | None = None, placed: R.Placed | None = None) -> tuple[DataFrame, DataFrame]:
    """The selected chunks of every question that can be asked, and one trace row for each of these questions.

    chunks: chunk_id, scope, parent, generation, embedding, tokens, cost
    (tokens of its text), or ``texts`` for its tokens; questions as for ``routed_search``, with budget
    (tokens of evidence). Candidates are collapsed by parent, reranked and cut to
    what was requested; of these the best go into the prompt as long as the
    budget holds. The trace has counts by stage, reasons in a fixed order, the
    generations that answered and a truncated hash of the question; it has no
    column that could hold a text. Null and blank questions have no trace.
    """
    routed = stored(route(questions, hybrid_enabled))
    found, near, said = routed_search(chunks, routed, pool, texts, placed)
    one = R.collapse_parents(found.join(chunks.select("chunk_id", "parent"), "chunk_id"))
    domains = found.select("question", "domain").distinct()
    candidates = stored(one.join(domains, "question").select("question", "chunk_id", "parent", "score", "rank", "domain"))
    ranked, stages = rerank(candidates, routed, chunks, scorer, least_chunks, texts)
    wanted = routed.where("mode IS NOT NULL").select("question", "requested", "budget")
    final = ranked.join(wanted, "question").where("rank <= requested").join(chunks.select("chunk_id", "generation", "cost"), "chunk_id")
    running = F.sum("cost").over(Window.partitionBy("question").orderBy("rank"))
    selected = stored(final.withColumn("fits", running <= F.col("budget")).drop("requested", "budget"))
    return selected.select("question", "chunk_id", "score", "rank", "domain", "fits"), _trace(routed, chunks, {"dense": near, "lexical": said, "fused": found, "deduplicated": candidates}, stages, selected)


def _trace(routed: DataFrame, chunks: DataFrame, rows: dict[str, DataFrame], stages: DataFrame, selected: DataFrame) -> DataFrame:
    marked = None
    for name, part in rows.items():
        named = part.select("question", F.lit(name).alias("stage"))
        marked = named if marked is None else marked.union(named)
    counts = marked.groupBy("question").agg(*(F.count_if(F.col("stage") == name).alias(name) for name in rows))
    chosen = selected.groupBy("question").agg(
        F.count("*").alias("selected"),
        (F.count_distinct("parent") + F.count_if(F.col("parent").isNull())).alias("unique_parents"),
        F.coalesce(F.sum(F.when(F.col("fits"), F.col("cost"))), F.lit(0)).alias("tokens_selected"),
        F.coalesce(F.sum(F.when(~F.col("fits"), F.col("cost"))), F.lit(0)).alias("tokens_dropped"),
        F.array_join(F.transform(F.array_sort(F.collect_set("generation")), lambda g: g.cast("string")), ",").alias("generation_ids"),
        F.max("domain").alias("score_domain"),
        F.count_if(~F.col("fits")).alias("cut"),
    )  # at most MAX_LIMIT rows a question
    held = chunks.groupBy("scope").agg(F.count("*").alias("held"))
    both = routed.where("mode IS NOT NULL").select("question", "scope", "text", "mode", "requested").join(held, "scope", "left")
    for part in (counts, chosen, stages):
        both = both.join(part, "question", "left")
    zero = ["held", *rows, "reranker_input", "reranker_output", "selected", "unique_parents", "tokens_selected", "tokens_dropped", "cut"]
    both = both.fillna(0, zero)
    short = F.col("selected") < F.col("requested")
    when = {
        "empty_corpus": F.col("held") == 0,
        "no_candidates": F.col("selected") == 0,
        "underfilled_top_k": (F.col("selected") > 0) & short & (F.col("selected") < F.col("held")),
        "reranker_absent": F.col("reason") == "reranker_absent",
        "reranker_failed": F.col("reason") == "reranker_failed",
        "dedup_shortfall": short & (F.col("fused") > F.col("deduplicated")),
        "evidence_dropped_for_budget": F.col("cut") > 0,
    }
    listed = F.array_compact(F.array(*(F.when(when[r], r) for r in REASONS if r in when)))
    return both.select(
        "question",
        "scope",
        "mode",
        F.substring(F.sha2(F.col("text"), 256), 1, 32).alias("query_hash"),
        "score_domain",
        F.coalesce("generation_ids", F.lit("")).alias("generation_ids"),
        *(F.col(s).alias(f"candidates_{s}") for s in STAGES),
        "unique_parents",
        "tokens_selected",
        "tokens_dropped",
        F.when(F.size(listed) == 0, "ok").otherwise(F.array_join(listed, ",")).alias("reasons"),
    )
