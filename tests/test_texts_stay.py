"""Texts are neither joined nor stored for a ranking: scopes come to the numbers of a text's words, as many rows as the join gives."""

import pytest

from docloom.operators import retrieval as R, routing as T
from docloom.plans import registry, retrieval_queries, routing_queries
from test_lexical import ASKED, TEXTS, by_counting

SF = "/root/testdata/sf0.001"


def test_scopes_that_a_join_tells(spark):
    texts = [(i, TEXTS[i * 3 % 8].split()) for i in range(40)] + [(3, "a b c a d".split()), (None, ["a", "b"])]
    labels = [(i, s) for i in range(0, 40, 2) for s in ([0, 1] if i % 6 == 0 else [1, 1] if i % 10 == 4 else [2])]
    told = {i: [s for j, s in labels if j == i] or [0] for i, _ in texts if i is not None} | {None: [None]}
    chunks = [(i, s, t) for i, t in texts for s in told[i]]
    questions = [(i, i % 3, ASKED[i % 9].split(), i % 2 == 0) for i in range(18)]
    left = spark.createDataFrame(texts, "chunk_id bigint, tokens array<string>").repartition(3)
    scopes = spark.createDataFrame([(i, s) for i, found in told.items() if i is not None for s in found], "chunk_id bigint, scope bigint")
    asked = spark.createDataFrame(questions, "question bigint, scope bigint, tokens array<string>, strict boolean")
    found = R.lexical_topk(left, asked, 4, block=7, placed=lambda rows: rows.join(scopes, "chunk_id", "left"))
    assert sorted(((r.question, r.chunk_id, r.score, r["rank"]) for r in found.collect()), key=repr) == by_counting(chunks, questions, 4, True)


@pytest.mark.parametrize("name", ["r2_lexical_search", "r3_hybrid_search", "r6_retrieval_pipeline", "r4_mode_routing"])
def test_no_stored_chunk_has_its_words(spark, monkeypatch, name):
    seen = []
    for module in (R, T, retrieval_queries, routing_queries):
        monkeypatch.setattr(module, "stored", lambda df, keep=module.stored: seen.append(df.columns) or keep(df))
    registry.QUERIES[name](spark, SF)
    assert [c for c in seen if "chunk_id" in c] and not [c for c in seen if "chunk_id" in c and "tokens" in c]
