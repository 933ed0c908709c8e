"""Evaluation and comparison on small made-up inputs."""

import math

from docloom.operators import evaluate as E


def scored(spark):
    questions = spark.createDataFrame([(1, "a", True, 4), (2, "a", True, 4), (3, "b", False, 2), (4, None, True, 0), (5, "b", True, 4)], "question int, category string, answerable boolean, requested int")
    results = spark.createDataFrame([(1, 10, 1, 5, 1), (1, 11, 1, 5, 2), (1, 12, 2, None, 3), (3, 30, 3, 7, 1), (3, 31, 4, 8, 2), (5, 50, 9, None, 1)], "question int, chunk_id int, source int, parent int, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 11), (1, 99), (2, 20), (5, 51)], "question int, chunk_id int")
    sources = spark.createDataFrame([(1, 1), (1, 1), (1, 8), (3, 3)], "question int, source int")
    forbidden = spark.createDataFrame([(3, 4), (3, 4), (1, 3)], "question int, source int")
    return E.evaluate(questions, results, relevant, sources, forbidden)


def test_metrics_of_each_question(spark):
    rows = {r["question"]: r for r in scored(spark).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert (rows[1]["recall_5"], rows[1]["rr"], rows[1]["ndcg_10"], rows[1]["source_recall"]) == (0.5, 0.5, round(1 / math.log2(3) / ideal, 6), 0.5)
    assert (rows[1]["duplicate_parents"], rows[1]["fill"], rows[1]["isolation_breach"]) == (round(1 / 3, 6), 0.75, False)
    assert (rows[2]["recall_10"], rows[2]["rr"], rows[2]["fill"], rows[2]["reasons"]) == (0.0, 0.0, 0.0, "no_candidates")
    assert (rows[3]["recall_10"], rows[3]["source_recall"], rows[3]["isolation_breach"], rows[3]["reasons"]) == (None, 1.0, True, "isolation_breach")
    assert (rows[4]["fill"], rows[4]["reasons"]) == (0.0, "no_candidates,missing_judgment")
    assert rows[1]["reasons"] == "underfilled_top_k,dedup_shortfall" and rows[5]["reasons"] == "underfilled_top_k"


def test_populations_and_comparison(spark):
    now = E.populations(scored(spark))
    rows = {r["population"]: r for r in now.collect()}
    assert set(rows) == {"overall", "category.a", "category.b"}
    assert (rows["overall"]["queries"], rows["overall"]["judged_queries"], rows["overall"]["isolation_failures"]) == (5, 3, 1)
    assert rows["overall"]["recall_5"] == round(0.5 / 3, 6) and rows["overall"]["source_recall"] == 0.75
    assert rows["category.b"]["judged_queries"] == 1

    settings = lambda *pairs: spark.createDataFrame(pairs, "field string, value string")
    kinds = lambda df: sorted((r["kind"], r["metric"], r["blocking"]) for r in df.collect())
    same = settings(("mode", "dense"), ("limit", "20"))
    always = [("isolation_failure", "category.b", True), ("isolation_failure", "overall", True), ("unmet_target", "overall.ndcg_10", False), ("unmet_target", "overall.recall_10", False)]
    assert kinds(E.compare(now, now, same, same)) == always
    worse = now.where("population <> 'category.a'").selectExpr("population", "queries", "judged_queries", "recall_10 - 0.03 AS recall_10", "ndcg_10 + 0.03 AS ndcg_10", "0L AS isolation_failures")
    found = kinds(E.compare(now, worse, same, settings(("mode", "hybrid"), ("split", "dev"), ("limit", "20")), enforce_targets=True))
    assert [f for f in found if f[0] == "incomparable"] == [("incomparable", "mode", True), ("incomparable", "split", True)]
    assert [f for f in found if f[0] == "missing_metric"] == [("missing_metric", "category.a", True)]
    assert [f for f in found if f[0] == "regression"] == [("regression", "category.b.recall_10", True), ("regression", "overall.recall_10", True)]
    assert [f[1] for f in found if f[0] == "improvement"] == ["category.b.ndcg_10", "overall.ndcg_10"]
    assert [f for f in found if f[0] == "unmet_target"] == [("unmet_target", "overall.ndcg_10", True), ("unmet_target", "overall.recall_10", True)]
    assert not [f for f in found if f[0] == "isolation_failure"]
