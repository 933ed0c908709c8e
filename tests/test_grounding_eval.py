"""Grounding evaluation and native citations on small made-up answers."""

from docloom.operators import grounding as G, grounding_eval as E


def place(answer, mark, nth=0):
    at = -1
    for _ in range(nth + 1):
        at = answer.index(mark, at + 1)
    return at, at + len(mark)


def test_claims_and_verdicts(spark):
    queries = spark.createDataFrame([("q1", "facts", "train", True, "nb"), ("q2", "facts", "train", False, "nb"), ("q3", "other", "train", True, "nb")], "query_id string, category string, split string, answerable boolean, notebook string")
    claims = spark.createDataFrame([("q1", "c1", ["four attempts"], ["k1"]), ("q1", "c2", ["Queue", "durable"], ["k2"]), ("q1", "c3", ["never said"], ["k1"]), ("q1", "c4", [], ["k1"]), ("q2", "x", ["a"], ["k1"])], "query_id string, claim_id string, markers array<string>, supported_by array<string>")
    answer = "It makes four ATTEMPTS [1], [2]. The queue is durable [3] and more [4]; four attempts, a durable queue [5]. [9]"
    cases = spark.createDataFrame(
        [("q1", "answered", answer, 0, ["g1"], True), ("q2", "answered", "No source was retrieved for it.", 0, ["g1"], True), ("q3", "provider_error", "", 3, ["g1"], True), ("gone", "answered", "x", 2, ["g1"], True)],
        "query_id string, outcome string, answer string, rejected int, generations array<string>, evidence_sufficient boolean",
    )
    cites = [("q1", i, *place(answer, f"[{n}]"), s, c, quote) for i, (n, s, c, quote) in enumerate([(1, "s", 1, "four attempts..."), (2, "s", 1, ""), (3, "s", 2, "not in it"), (4, "s", 2, "The queue"), (5, "s", 1, "four"), (9, "s", 99, "")])]
    citations = spark.createDataFrame(cites, "query_id string, pos int, start int, stop int, source_id string, chunk_index int, quote string")
    chunks = spark.createDataFrame([("k1", "s", 1, "nb", "makes four attempts"), ("k2", "s", 2, "nb", "The queue is durable"), ("k3", "s", 3, "else", "x")], "chunk_id string, source_id string, chunk_index int, chunk_notebook string, content string")
    live = E.read_cases(cases, queries).where("query_id = 'q1'")
    asserted = claims.where("claim_id IN ('c1', 'c2')")
    judged = E.judge(live, claims, chunks, E.associate(live, asserted, citations), "g1").orderBy("pos").collect()
    # the first two are a run; "and more" asserts nothing; the fifth has two claims before it, and the last follows it in a run
    assert [(r.claim_id, r.verdict) for r in judged] == [("c1", "correct"), ("c1", "correct"), ("c2", "span_mismatch"), (None, "unrelated_to_claim"), (None, "unrelated_to_claim"), (None, "unknown_chunk")]
    rows = {r.query_id: r for r in E.evaluate(queries, claims, cases, citations, chunks, "g1").collect()}
    assert (rows["q1"]["class"], rows["q1"].expected_claims, rows["q1"].asserted_claims, rows["q1"].supported_claims, rows["q1"].citations) == ("ok", 4, 2, 1, 6)
    assert (rows["q2"]["class"], rows["q2"].abstention_correct) == ("ok", True)
    assert (rows["q3"]["class"], rows["q3"].abstention_correct, rows["q3"].citations) == ("provider_error", False, 0)
    assert (rows["gone"]["class"], rows["gone"].citations, rows["gone"].category) == ("unknown_query", 0, "unknown")
    total = E.report(E.evaluate(queries, claims, cases, citations, chunks, "g1")).where("category IS NULL").first()
    assert (total.cases, total.citation_precision, total.citation_coverage, total.expected_claim_coverage, total.class_unknown_query) == (4, 0.333333, 0.5, 0.4, 1)
    stale = E.judge(live, claims, chunks, E.associate(live, asserted, citations), "g9")
    assert {r.verdict for r in stale.collect()} == {"stale_generation", "unknown_chunk"}
    assert E.report(E.evaluate(queries, claims, cases.limit(0), citations, chunks, "g1")).count() <= 1


def test_native_citations(spark):
    text = "The retry budget is four attempts. The queue keeps jobs."
    answers = spark.createDataFrame([("a", "The retry budget is four attempts. `The queue keeps jobs`"), ("b", None)], "answer_id string, answer string")
    said = "The retry budget is four attempts"
    native = spark.createDataFrame(
        [("a", 0, 3, said, 33), ("a", 1, 0, said, 33), ("a", 2, 0, said, 33), ("a", 3, 0, "five attempts", 33), ("a", 4, 1, said, 33), ("a", 5, 0, "The queue keeps jobs", 55), ("a", 6, 0, "  ", 33), ("a", 7, 2, said, 33), ("a", 8, 0, "The queue keeps jobs", 33), ("b", 0, 0, said, 3)],
        "answer_id string, pos int, document_index int, cited_text string, marker_start int",
    )
    schema = "answer_id string, document_index int, source_id int, generation_id string, chunk_index int, metadata string"
    documents = spark.createDataFrame([("a", 0, 1, "g", 0, "m"), ("a", 1, 2, "g", 0, "shifted"), ("a", 2, 3, "old", 0, "m")], schema)
    context = spark.createDataFrame([("a", 0, 1, "g", 0, "m", text, True), ("a", 1, 2, "g", 0, "m", text, True), ("a", 2, 3, "old", 0, "m", text, True)], f"{schema}, content string, owned boolean")
    active = spark.createDataFrame([(1, "g"), (2, "g"), (3, "g")], "source_id int, active_generation_id string")
    found = {(r.answer_id, r.pos): (r.number, r.reason) for r in G.resolve_native(answers, native, documents, context, active).collect()}
    assert found == {
        ("a", 0): (None, "missing"), ("a", 1): (1, "cited"), ("a", 2): (1, "repeated"), ("a", 3): (1, "not_quoted"), ("a", 4): (2, "unowned"), ("a", 5): (1, "in_code"),
        ("a", 6): (1, "not_quoted"), ("a", 7): (3, "stale"), ("a", 8): (1, "unlinked"), ("b", 0): (None, "missing"),
    }
