"""Stuffing and corrective retrieval on small made-up inputs."""

from pyspark.sql import functions as F

from docloom.operators import context as C, grounding as G


def test_a_stuffed_scope_fits_its_budget(spark):
    rows = [(1, 1, "t", None, " a <b> "), (1, 2, "t & u", 7, "é"), (2, 3, "t", None, "x" * 500), (3, 4, "t", None, "y"), (3, 5, "t", None, "y"), (5, 6, "t", None, None)]
    chunks = spark.createDataFrame(rows, "scope int, source_id int, title string, page int, body string")
    region = G.evidence(chunks.where("scope = 1").withColumn("rank", F.col("source_id")).withColumn("k", F.lit(1)), "k").first()["evidence"]
    cost = len(region.encode())
    settings = spark.createDataFrame([(1, 5, 5, cost + 3), (2, 5, 5, 400), (3, 1, 5, 9999), (4, 5, 5, 9999), (5, 5, 5, 9999), (6, 0, 5, 0)], "scope int, threshold int, requested int, budget int")
    decided, loaded = C.stuff_scopes(chunks, settings, ["source_id"])
    got = {r["scope"]: r["decision"] for r in decided.collect()}
    assert got == {1: "stuffed", 2: "over_budget", 3: "searched", 4: "empty", 5: "searched", 6: "empty"}
    # never below what the region has, and at most one token a part above it
    assert cost <= next(r["cost"] for r in decided.collect() if r["scope"] == 1) <= cost + 4
    assert [(r["scope"], r["source_id"], r["index"]) for r in loaded.orderBy("index").collect()] == [(1, 1, 1), (1, 2, 2)]


def test_only_short_questions_run_again(spark):
    questions = spark.createDataFrame([(i, 0, ["a"]) for i in range(5)], "question int, scope int, tokens array<string>")
    rewritten = spark.createDataFrame([(0, ["b"]), (1, ["b"]), (2, ["b"]), (3, ["b"])], "question int, tokens array<string>")
    corpus = spark.createDataFrame([(0, 50)], "scope int, held int")
    asked = []
    # question: (parents in the first pass, in the second)
    gives = {0: (3, 9), 1: (1, 2), 2: (1, 1), 3: (0, 3), 4: (0, 9)}

    def search(q):
        rows = q.collect()
        asked.append({r["question"] for r in rows})
        found = [(r["question"], 10 * p + n, p, 1.0, p + 1) for r in rows for n in [0] for p in range(gives[r["question"]][0 if r["tokens"] == ["a"] else 1])]
        return spark.createDataFrame(found, "question int, chunk_id int, parent int, score double, rank int")

    results, turns = C.corrective_retrieval(questions, rewritten, corpus, search, 5, 3)
    assert asked == [{0, 1, 2, 3, 4}, {1, 2, 3}]
    assert {r["question"]: (r["outcome"], r["parents"], r["sufficient"], r["underfilled"]) for r in turns.collect()} == {
        0: ("kept", 3, True, True), 1: ("corrected", 2, False, True), 2: ("retried", 1, False, True), 3: ("corrected", 3, True, True), 4: ("skipped", 0, False, True),
    }
    assert {(r["question"], r["pass"]) for r in results.collect()} == {(0, 1), (1, 2), (2, 1), (3, 2)}
