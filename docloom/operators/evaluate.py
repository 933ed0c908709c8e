"""Retrieval metrics per question, their means by population, and the comparison of two runs; every value is rounded to six decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TOLERANCE = 0.02
# Absolute goals of a release.
TARGETS = {"recall_10": 0.90, "ndcg_10": 0.75}
#: Metrics of judged questions, of questions with judged sources, and of all.
JUDGED = ("recall_5", "recall_10", "recall_20", "rr", "ndcg_10")
MEANS = (*JUDGED, "source_recall", "duplicate_parents", "fill")


def evaluate(questions: DataFrame, results: DataFrame, relevant: DataFrame, relevant_sources: DataFrame, forbidden: DataFrame) -> DataFrame:
    """One row for each question with its metrics, whether a forbidden source was found, and reasons.

    questions: question, category, answerable, requested; results: question,
    chunk_id, source, parent, rank; relevant: question, chunk_id;
    relevant_sources and forbidden: question, source. Ranking metrics are null
    for a question without judged chunks, which is ``missing_judgment`` where it
    can be answered, and source recall without judged sources. Judgments that
    name what nothing returned still count; repeated ones count once.
    """
    judged = relevant.distinct().withColumn("hit", F.lit(True))
    sources = relevant_sources.distinct().withColumn("wanted", F.lit(True))
    barred = forbidden.distinct().withColumn("barred", F.lit(True))
    rows = results.join(judged, ["question", "chunk_id"], "left").join(sources, ["question", "source"], "left").join(barred, ["question", "source"], "left")
    hit = F.coalesce("hit", F.lit(False))
    recall = lambda k: F.count_if(hit & (F.col("rank") <= k))
    found = rows.groupBy("question").agg(
        recall(5).alias("h5"),
        recall(10).alias("h10"),
        recall(20).alias("h20"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(hit & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.count_distinct(F.when(F.col("wanted"), F.col("source"))).alias("sources"),
        F.count_if("barred").alias("breaches"),
        F.count("*").alias("returned"),
        (F.count_distinct("parent") + F.count_if(F.col("parent").isNull())).alias("parents"),
    )
    totals = judged.groupBy("question").agg(F.count("*").alias("n_relevant")), sources.groupBy("question").agg(F.count("*").alias("n_sources"))
    both = questions.join(found, "question", "left").join(totals[0], "question", "left").join(totals[1], "question", "left")
    both = both.fillna(0, ["h5", "h10", "h20", "dcg", "sources", "breaches", "returned", "parents"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    share = lambda c, n: F.round(F.col(c) / F.col(n), 6)
    is_judged = F.col("n_relevant").isNotNull()
    when = {
        "no_candidates": F.col("returned") == 0,
        "underfilled_top_k": (F.col("returned") > 0) & (F.col("returned") < F.col("requested")),
        "dedup_shortfall": F.col("parents") < F.col("returned"),
        "missing_judgment": F.col("answerable") & ~is_judged,
        "isolation_breach": F.col("breaches") > 0,
    }
    reasons = F.array_compact(F.array(*(F.when(c, r) for r, c in when.items())))
    return both.select(
        "question",
        "category",
        share("h5", "n_relevant").alias("recall_5"),
        share("h10", "n_relevant").alias("recall_10"),
        share("h20", "n_relevant").alias("recall_20"),
        F.when(is_judged, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)).alias("rr"),
        F.when(is_judged, F.round(F.col("dcg") / ideal, 6)).alias("ndcg_10"),
        share("sources", "n_sources").alias("source_recall"),
        F.round(F.when(F.col("returned") == 0, 0.0).otherwise((F.col("returned") - F.col("parents")) / F.col("returned")), 6).alias("duplicate_parents"),
        F.round(F.when(F.col("requested") <= 0, 0.0).otherwise(F.least(F.col("returned") / F.col("requested"), F.lit(1.0))), 6).alias("fill"),
        (F.col("breaches") > 0).alias("isolation_breach"),
        F.when(F.size(reasons) == 0, "ok").otherwise(F.array_join(reasons, ",")).alias("reasons"),
    )


def populations(metrics: DataFrame) -> DataFrame:
    """population (``overall`` or ``category.<name>``), queries, judged_queries, the mean of every metric over those that have it (0 for none), isolation_failures.

    One pass over both groupings. A null category counts overall only.
    """
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in MEANS]
    grouped = metrics.select("category", *MEANS, "isolation_breach").select("*", F.explode(F.array(F.lit("overall"), F.concat(F.lit("category."), "category"))).alias("population")).where("population IS NOT NULL")
    return grouped.groupBy("population").agg(F.count("*").alias("queries"), F.count("recall_10").alias("judged_queries"), *means, F.count_if("isolation_breach").alias("isolation_failures"))


def compare(before: DataFrame, after: DataFrame, settings_before: DataFrame, settings_after: DataFrame, targets: dict[str, float] = TARGETS, enforce_targets: bool = False) -> DataFrame:
    """Every finding of two evaluations as a row: kind, metric, previous, current, delta, blocking.

    before and after are what ``populations`` gives; settings (field, value) tell
    what was measured. Settings that differ make the two incomparable. A
    population that is gone is a missing metric; one without a judged question on
    either side is not compared. A fall beyond the tolerance is a regression, a
    rise an improvement. A forbidden source in the later run blocks whatever its
    metrics are. Unmet targets of the overall population block only if enforced.
    """
    none = F.lit(None).cast("double")
    row = lambda kind, metric, previous, current, delta, blocking: (F.lit(kind).alias("kind"), metric.alias("metric"), previous.alias("previous"), current.alias("current"), delta.alias("delta"), F.lit(blocking).alias("blocking"))
    both = settings_before.select("field", F.col("value").alias("a")).join(settings_after.select("field", F.col("value").alias("b")), "field", "full")
    incomparable = both.where("NOT a <=> b").select(*row("incomparable", F.col("field"), none, none, none, True))
    sides = before.select("population", F.struct("*").alias("a")).join(after.select("population", F.struct("*").alias("b")), "population", "left")
    missing = sides.where("b IS NULL").select(*row("missing_metric", F.col("population"), none, none, none, True))
    values = F.array(*(F.struct(F.lit(m).alias("name"), F.col(f"a.{m}").alias("x"), F.col(f"b.{m}").alias("y")) for m in targets))
    compared = sides.where("b IS NOT NULL AND (population = 'overall' OR a.judged_queries > 0 OR b.judged_queries > 0)").select("population", F.inline(values))
    deltas = compared.withColumn("d", F.round(F.col("y") - F.col("x"), 6))
    named = F.concat("population", F.lit("."), "name")
    worse = deltas.where(F.col("d") < -TOLERANCE).select(*row("regression", named, F.col("x"), F.col("y"), F.col("d"), True))
    better = deltas.where(F.col("d") > TOLERANCE).select(*row("improvement", named, F.col("x"), F.col("y"), F.col("d"), False))
    leaked = after.where("isolation_failures > 0").select(*row("isolation_failure", F.col("population"), none, F.col("isolation_failures").cast("double"), none, True))
    goals = F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).alias("y"), F.lit(goal).alias("goal")) for m, goal in targets.items()))
    unmet = after.where("population = 'overall'").select("population", F.inline(goals)).where(F.col("y") < F.col("goal"))
    missed = unmet.select(*row("unmet_target", named, F.col("goal"), F.col("y"), F.round(F.col("y") - F.col("goal"), 6), enforce_targets))
    out = incomparable
    for part in (missing, worse, better, leaked, missed):
        out = out.unionByName(part)
    return out
