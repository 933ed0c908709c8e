"""Citations, pages, time ranges and the cache against small made-up inputs."""

from pyspark.sql import functions as F

from docloom.functions import citations as C
from docloom.operators import grounding as G, lifecycle as L


def test_preceding_claim(spark):
    cases = {
        "One. Two": "Two", "Costs 3.5 euros ": "Costs 3.5 euros", "First! - second : x": "second : x", "a\n* b c": "b c", "Ends.": "", "v1.2.3 is out": "v1.2.3 is out", "x. ; y": "y", "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "prefix string, want string")
    assert [r for r in df.select("prefix", C.preceding_claim(F.col("prefix")).alias("got"), "want").collect() if r["got"] != r["want"]] == []


def test_citations_by_first_broken_rule(spark):
    answers = spark.createDataFrame([
        ("a", "The harbour opened again in 1999 [1]. `code [1]` The harbour opened again in 1998 [1]. The harbour opened again in 1999 [1]. Harbour opened again [9]. Harbour opened [2]. Harbour opened [3]. [1] Harbour opened [4]."),
        ("b", "no SOURCE was retrieved"), ("c", None),
    ], "answer_id string, answer string")
    text = "The harbour opened again in 1999."
    context = spark.createDataFrame([("a", 1, 10, "g", text, True), ("a", 2, 11, None, text, True), ("a", 3, 12, "old", text, True), ("a", 4, 10, "g", text, False)], "answer_id string, n long, source_id long, generation_id string, content string, owned boolean")
    active = spark.createDataFrame([(10, "g"), (11, "g"), (12, "g")], "source_id long, active_generation_id string")
    found = G.verify_citations(answers, context, active)
    assert [r["reason"] for r in found.orderBy("pos").collect()] == ["cited", "unsupported", "duplicate", "missing_chunk", "no_generation", "stale", "unsupported", "unowned"]
    got = {r["answer_id"]: tuple(r)[1:] for r in G.citation_summary(answers, found).collect()}
    assert got == {"a": (1, 7, False), "b": (0, 0, True), "c": (0, 0, False)}
    assert G.verify_citations(answers.limit(0), context, active).count() == 0


def test_pages_and_times(spark):
    pages = spark.createDataFrame([("d", 1, 0), ("d", 2, 10), ("d", 3, 10), ("e", 1, 5)], "k string, page long, start long")
    asked = spark.createDataFrame([("d", 0), ("d", 9), ("d", 10), ("d", 99), ("e", 0)], "k string, offset long")
    got = [tuple(r) for r in G.page_lookup(pages, asked, "k").orderBy("k", "offset").collect()]
    assert got == [("d", 0, 1), ("d", 9, 1), ("d", 10, 3), ("d", 99, 3), ("e", 0, 1)]
    texts = spark.createDataFrame([("[01:30] a\n  [00:05] b\n[x:1] c\nd [09:00]",), ("none",), (None,)], "t string")
    assert [tuple(r["r"]) for r in texts.select(G.time_range(F.col("t")).alias("r")).collect()] == [(5.0, 90.0), (None, None), (None, None)]


def test_cache_insert(spark):
    schema = "source_id long, content_hash string, model string, body string"
    cache = spark.createDataFrame([(1, "h1", "m", "one"), (2, "h2", "m", "two"), (3, "h3", "m", "three")], schema)
    new = spark.createDataFrame([(1, "h9", "m", "nine"), (4, "h2", "m", "again"), (3, "h3", "m", "same")], schema)
    got = sorted(tuple(r) for r in L.cache_insert(cache, new).select("source_id", "content_hash", "model", "body").collect())
    assert got == [(1, "h9", "m", "nine"), (3, "h3", "m", "three"), (4, "h2", "m", "two")]
