"""Mode routing, reranking and the trace on small made-up inputs."""

from docloom.operators import routing as T

QUESTION = "question int, scope int, text string, tokens array<string>, embedding array<double>, mode string, requested int, min_relevance double, lexical_ok boolean, budget int"
CHUNK = "chunk_id bigint, scope int, parent bigint, generation int, embedding array<double>, tokens array<string>, cost int"


def chunks(spark):
    rows = [(i, 0, i // 2, i % 2, [1.0, float(i)], ["alpha", f"w{i}"] + (["beta"] if i % 3 == 0 else []), 10) for i in range(6)]
    return spark.createDataFrame([*rows, (6, 1, None, 7, None, ["alpha"], 10), (7, 1, None, 7, None, ["alpha", "beta"], 10)], CHUNK)


def ask(spark, *rows):
    """question, scope, text, mode, requested, least, lexical_ok, budget"""
    return spark.createDataFrame([(q, s, t, (t or "").split(), [1.0, 0.0], m, n, least, ok, b) for q, s, t, m, n, least, ok, b in rows], QUESTION)


def test_routes_and_refusals(spark):
    routed = T.route(ask(spark, (1, 0, " \n", "dense", 5, 0.0, True, 99), (2, 0, None, "dense", 5, 0.0, True, 99), (3, 0, "a", "other", 5, 0.0, True, 99), (4, 0, "a", None, 5, 0.0, True, 99), (5, 0, "a", "hybrid", 9999, 0.0, True, 99), (6, 1, "a", "hybrid", -3, 0.0, True, 99), (7, 1, "a", "lexical", None, 0.0, True, 99)), "scope <> 1")
    got = {r["question"]: (r["error"], r["mode"], r["requested"]) for r in routed.collect()}
    assert got == {1: ("empty_query", None, 5), 2: ("empty_query", None, 5), 3: ("unknown_mode", None, 5), 4: ("unknown_mode", None, 5), 5: (None, "hybrid", 500), 6: (None, "dense", 1), 7: (None, "lexical", 1)}


def test_modes_keep_their_own_scores(spark):
    routed = T.route(ask(spark, (1, 0, "alpha beta", "dense", 5, 0.5, True, 99), (2, 0, "alpha beta", "lexical", 5, 0.0, True, 99), (3, 0, "beta", "hybrid", 5, 0.0, True, 99), (4, 0, "beta", "hybrid", 5, 0.0, False, 99), (5, 0, "beta", "lexical", 5, 0.0, False, 99), (6, 1, "alpha", "dense", 5, 0.0, True, 99)))
    found, near, said = T.routed_search(chunks(spark), routed, 10)
    rows = found.orderBy("question", "rank").collect()
    by = lambda q: [r for r in rows if r["question"] == q]
    assert [r["chunk_id"] for r in by(1)] == [0, 1] and {r["domain"] for r in by(1)} == {"dense_similarity"}
    assert {r["chunk_id"] for r in by(2)} == {0, 3} and {r["domain"] for r in by(2)} == {"lexical_rank"}
    assert [r["score"] for r in by(4)] == [round(1 / (60 + r["rank"]), 6) for r in by(4)] and len(by(4)) == 6
    assert {r["chunk_id"] for r in by(3)} == set(range(6)) and by(3)[0]["score"] > by(4)[0]["score"]
    assert by(5) == [] and by(6) == []
    assert {r["question"] for r in near.collect()} == {1, 3, 4} and {r["question"] for r in said.collect()} == {2, 3}


def test_rerank_keeps_the_order_where_it_fails(spark):
    pool = spark.createDataFrame([(q, c, c // 2, 1.0 / (c + 1), c + 1, "rrf_rank") for q in (1, 2, 3) for c in range(4)] + [(4, 7, None, 1.0, 1, "rrf_rank")], "question int, chunk_id bigint, parent bigint, score double, rank int, domain string")
    routed = T.route(ask(spark, *((q, 1 if q == 4 else 0, "beta", "hybrid", 5, 0.0, True, 99) for q in (1, 2, 3, 4))))

    def scorer(pairs):
        return pairs.sparkSession.createDataFrame([(1, 0, 0.1), (1, 3, 0.9), (1, 2, float("nan")), (1, 1, 0.9), (1, 1, 0.2), (1, 99, 5.0), (2, 0, float("inf")), (2, 1, None)], "question int, chunk_id bigint, relevance double")

    ranked, stages = T.rerank(pool, routed, chunks(spark), scorer, 3)
    order = {q: [(r["chunk_id"], r["domain"]) for r in ranked.where(f"question = {q}").orderBy("rank").collect()] for q in (1, 2, 3, 4)}
    assert order[1] == [(c, "reranker_relevance") for c in (1, 3, 0)]
    assert order[2] == order[3] == [(c, "rrf_rank") for c in range(4)] and order[4] == [(7, "rrf_rank")]
    assert {r["question"]: (r["reranker_input"], r["reranker_output"], r["reason"]) for r in stages.collect()} == {1: (4, 3, None), 2: (4, 0, "reranker_failed"), 3: (4, 0, "reranker_failed")}
    same, stages = T.rerank(pool, routed, chunks(spark), None, 3)
    assert sorted(same.collect()) == sorted(pool.collect())
    assert {r["reason"] for r in stages.collect()} == {"reranker_absent"}


def test_a_trace_tells_what_happened_and_holds_no_text(spark):
    secret = "alpha beta"
    asked = ask(spark, (1, 0, secret, "dense", 2, 0.0, True, 99), (2, 0, secret, "dense", 3, 0.0, True, 15), (3, 9, secret, "hybrid", 3, 0.0, True, 99), (4, 0, "nothing", "lexical", 3, 0.0, True, 99), (5, 0, " ", "dense", 3, 0.0, True, 99), (6, 0, secret, "dense", 5, 0.0, True, 99))
    selected, trace = T.traced_retrieval(chunks(spark), asked, 10, T.word_overlap, 100)
    rows = {r["question"]: r.asDict() for r in trace.collect()}
    assert {q: r["reasons"] for q, r in rows.items()} == {
        1: "ok", 2: "evidence_dropped_for_budget", 3: "empty_corpus,no_candidates", 4: "no_candidates", 6: "underfilled_top_k,dedup_shortfall",
    }
    assert (rows[2]["tokens_selected"], rows[2]["tokens_dropped"], rows[2]["unique_parents"]) == (10, 20, 3)
    assert (rows[6]["candidates_dense"], rows[6]["candidates_fused"], rows[6]["candidates_deduplicated"], rows[6]["candidates_selected"]) == (6, 6, 3, 3)
    assert all("alpha" not in str(v) for r in rows.values() for v in r.values()) and all(len(r["query_hash"]) == 32 for r in rows.values())
    assert selected.where("question = 2").where("fits").count() == 1
    absent = T.traced_retrieval(chunks(spark), asked, 10, None, 1)[1]
    assert {r["reasons"] for r in absent.where("question IN (1, 3)").collect()} == {"reranker_absent", "empty_corpus,no_candidates"}


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], CHUNK)
    selected, trace = T.traced_retrieval(nothing, ask(spark, (1, 0, "a", "hybrid", 3, 0.0, True, 9)), 10, T.word_overlap, 0)
    assert selected.count() == 0 and [r["reasons"] for r in trace.collect()] == ["empty_corpus,no_candidates"]
    selected, trace = T.traced_retrieval(chunks(spark), spark.createDataFrame([], QUESTION), 10, T.word_overlap, 0)
    assert selected.count() == trace.count() == 0
