"""The best chunks by BM25 against a count in plain Python, over blocks, scopes, repeated ids and questions that want all words."""

import math
from collections import Counter, defaultdict

import pytest

from docloom.operators import retrieval as R

TEXTS = ["a b c a", "b c", "a a a d e", "", "c d e f g h", "a b", "x y z", "b b c c d"]
ASKED = ["a b", "c d d", "e", "nowhere", "", "b c a", "x a", "f g h c", "d"]


def by_counting(chunks, questions, k, scoped):
    known = [(c, s, t) for c, s, t in chunks if t is not None]
    mean = max(sum(len(t) for _, _, t in known) / len(known), 1.0)
    words = defaultdict(Counter)
    for c, s, t in known:
        for w in t:
            words[c, s, len(t)][w] += 1
    df = Counter(w for found in words.values() for w in found)
    out = []
    for q, scope, tokens, strict in questions:
        scores, have = defaultdict(float), defaultdict(set)
        for (c, s, length), found in words.items():
            for w, times in Counter(tokens).items():
                if found[w] and (not scoped or (s == scope and s is not None)):
                    idf = max(math.log((len(chunks) - df[w] + 0.5) / (df[w] + 0.5)), 0.0)
                    scores[c] += idf * times * found[w] * (R.K1 + 1) / (found[w] + R.K1 * (1 - R.B + R.B * length / mean))
                    have[c].add(w)
        best = sorted((-round(x, 6), -math.inf if c is None else c) for c, x in scores.items() if not strict or have[c] == set(tokens))
        out += [(q, None if c == -math.inf else c, -x, i) for i, (x, c) in enumerate(best[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("cells", [1, R.CELLS])
def test_lexical_ranking_against_counting(spark, monkeypatch, scoped, cells):
    monkeypatch.setattr(R, "CELLS", cells)
    chunks = [(i, (None, 0, 1, 2)[i % 4], TEXTS[i * 3 % 8].split()) for i in range(60)] + [(3, 2, "a b c a d".split()), (3, 2, "b a d e f".split()), (3, 2, "a".split()), (None, 1, ["a", "b"]), (61, 1, None)]
    questions = [(i, (0, 1, 2, None)[i % 4], ASKED[i % 9].split(), i % 2 == 0) for i in range(20)]
    own = ["scope"] if scoped else []
    left = spark.createDataFrame(chunks, "chunk_id bigint, scope int, tokens array<string>").repartition(3).select("chunk_id", *own, "tokens")
    asked = spark.createDataFrame(questions, "question bigint, scope int, tokens array<string>, strict boolean")
    found = R.lexical_topk(left, asked, 4, block=7)
    assert sorted(((r.question, r.chunk_id, r.score, r["rank"]) for r in found.collect()), key=repr) == by_counting(chunks, questions, 4, scoped)
    assert R.lexical_topk(left.where("false"), asked, 4).collect() == R.lexical_topk(left, asked.where("false"), 4).collect() == []
