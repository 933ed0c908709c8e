"""Mode routing, reranking with its fallbacks and the redacted trace, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import retrieval as R, routing as T
from docloom.operators.stored import stored
from docloom.plans.registry import query, table
from docloom.plans.retrieval_queries import POOL, RANK, TOK_SQL

#: A reranker is asked where a scope has so many chunks.
LEAST_CHUNKS = 50
BUDGET = 4000

_SNAP_SQL = rf"""
ch AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 50 = 0 THEN 3 ELSE doc_id % 3 END AS scope, doc_id // 4 AS parent, doc_id % 5 AS generation, embedding::DOUBLE[] AS e, {TOK_SQL.format('text')} AS tokens, CAST(ceil(strlen(text) / 4.0::DOUBLE * 1.1::DOUBLE) AS BIGINT) AS cost
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
q0 AS (SELECT item_id AS question, CASE WHEN item_id % 11 = 10 THEN 9 WHEN item_id % 10 = 5 THEN 3 ELSE item_id % 3 END AS scope, CASE WHEN item_id % 13 = 12 THEN ' ' || chr(10) ELSE text END AS text,
  CASE WHEN item_id % 17 = 16 THEN 'semantic' ELSE ['hybrid', 'dense', 'lexical', 'hybrid'][item_id % 4 + 1] END AS asked, item_id % 8 <> 3 AS ok, CASE WHEN item_id % 7 = 6 THEN 900 WHEN item_id % 7 = 5 THEN 0 ELSE 10 END AS wish,
  CASE WHEN item_id % 6 = 1 THEN 0.1 ELSE 0 END AS least, embedding::DOUBLE[] AS e FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
rt AS (SELECT *, {TOK_SQL.format('text')} AS tokens, least(greatest(wish, 1), {T.MAX_LIMIT}) AS requested, {BUDGET} AS budget,
  CASE WHEN trim(text, ' ' || chr(10)) = '' THEN 'empty_query' WHEN asked = 'semantic' THEN 'unknown_mode' END AS error FROM q0),
qs AS (SELECT *, CASE WHEN asked = 'hybrid' AND scope = 1 THEN 'dense' ELSE asked END AS mode FROM rt WHERE error IS NULL),
near AS (SELECT question, chunk_id, score, {RANK} AS rank FROM (SELECT question, chunk_id, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM ch c JOIN qs q USING (scope) WHERE c.e IS NOT NULL AND q.e IS NOT NULL AND mode <> 'lexical') QUALIFY rank <= {POOL}),
terms AS (SELECT question, scope, mode, term, count(*) AS times FROM (SELECT question, scope, mode, unnest(tokens) AS term FROM qs WHERE mode <> 'dense' AND ok) GROUP BY ALL),
st AS (SELECT count(*) AS n, greatest(avg(len(tokens)), 1.0) AS mean FROM ch),
hits AS (SELECT term, chunk_id, scope, length, count(*) AS tf FROM (SELECT chunk_id, scope, len(tokens) AS length, unnest(tokens) AS term FROM ch) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
need AS (SELECT question, count(*) AS need FROM terms GROUP BY question),
bm AS (SELECT question, mode, chunk_id, count(*) AS have, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * times * tf * ({R.K1} + 1) / (tf + {R.K1} * (1 - {R.B} + {R.B} * length / mean))), 6) AS score
  FROM hits JOIN terms USING (term, scope) JOIN df USING (term), st GROUP BY question, mode, chunk_id),
said AS (SELECT question, chunk_id, score, {RANK} AS rank FROM bm JOIN need USING (question) WHERE mode = 'hybrid' OR have = need QUALIFY rank <= {POOL}),
every AS (SELECT question, chunk_id, score, rank, 'dense_similarity' AS domain FROM near JOIN qs USING (question) WHERE mode = 'dense' UNION ALL SELECT question, chunk_id, score, rank, 'lexical_rank' FROM said JOIN qs USING (question) WHERE mode = 'lexical'
  UNION ALL SELECT question, chunk_id, score, {RANK}, 'rrf_rank' FROM (SELECT question, chunk_id, round(sum(part), 6) AS score FROM (SELECT question, chunk_id, 1.0::DOUBLE / (60 + rank) AS part FROM near JOIN qs USING (question) WHERE mode = 'hybrid' UNION ALL SELECT question, chunk_id, 0.25::DOUBLE / (60 + rank) FROM said JOIN qs USING (question) WHERE mode = 'hybrid') GROUP BY ALL)),
found AS (SELECT e.question, chunk_id, score, CAST(rank AS INT) AS rank, domain FROM every e JOIN qs USING (question) WHERE score >= least)"""

_RERANK_SQL = f"""{_SNAP_SQL},
cand AS (SELECT question, parent, min_by(chunk_id, rank) AS chunk_id, min_by(score, rank) AS score, any_value(domain) AS domain, min(rank) AS first_at FROM found JOIN ch USING (chunk_id) GROUP BY question, parent),
size_ AS (SELECT scope, count(*) AS held FROM ch GROUP BY scope),
pool AS (SELECT c.*, CAST(row_number() OVER (PARTITION BY c.question ORDER BY first_at) AS INT) AS rank, held >= {LEAST_CHUNKS} AS ready, held >= {LEAST_CHUNKS} AND question % 5 <> 4 AS judged FROM cand c JOIN qs USING (question) JOIN size_ USING (scope)),
over_ AS (SELECT question, chunk_id, parent, round(len(list_intersect(list_distinct(q.tokens), c.tokens)) / greatest(len(list_distinct(q.tokens)), 1), 6) AS score FROM pool JOIN (SELECT question, tokens FROM qs) q USING (question) JOIN (SELECT chunk_id, tokens FROM ch) c USING (chunk_id) WHERE judged),
ranked AS (SELECT question, chunk_id, parent, score, rank, domain FROM pool WHERE NOT judged UNION ALL SELECT question, chunk_id, parent, score, CAST({RANK} AS INT), 'reranker_relevance' FROM over_),
sel AS (SELECT r.question, chunk_id, r.parent, score, rank, domain, generation, cost, sum(cost) OVER (PARTITION BY r.question ORDER BY rank) <= budget AS fits FROM ranked r JOIN qs USING (question) JOIN ch USING (chunk_id) WHERE rank <= requested)"""


def _scope(doc):
    return F.when(doc % 50 == 0, 3).otherwise(doc % 3)


def _chunks(spark, d):
    """All documents as chunks without their texts."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    doc = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("cost"))
    return stored(docs.join(v.hint("merge"), "doc_id", "left").select(doc.alias("chunk_id"), _scope(doc).alias("scope"), F.floor(doc / 4).alias("parent"), (doc % 5).alias("generation"), "embedding", "cost"))


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _placed(spark, d):
    """Adds the scopes of ``_chunks`` to rows of chunks, one row for each vector of equal id there too."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return lambda rows: rows.join(v.hint("merge"), "chunk_id", "left").withColumn("scope", _scope(F.col("chunk_id")))


def _questions(spark, d):
    """All benchmark items in three modes, with planted faults: blank texts, an unknown mode, an empty scope, odd limits and a lexical ranking that is not to be had."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    i = F.col("item_id")
    text = F.when(i % 13 == 12, " \n").otherwise(F.col("text"))
    mode = F.when(i % 17 == 16, "semantic").otherwise(F.get(F.array(*map(F.lit, ("hybrid", "dense", "lexical", "hybrid"))), (i % 4).cast("int")))
    return table(spark, d, "benchmark").join(v, "item_id", "left").select(
        i.alias("question"),
        F.when(i % 11 == 10, 9).when(i % 10 == 5, 3).otherwise(i % 3).alias("scope"),
        text.alias("text"),
        X.lexical_tokens(text).alias("tokens"),
        "embedding",
        mode.alias("mode"),
        F.when(i % 7 == 6, 900).when(i % 7 == 5, 0).otherwise(10).alias("requested"),
        F.when(i % 6 == 1, 0.1).otherwise(0.0).alias("min_relevance"),
        (i % 8 != 3).alias("lexical_ok"),
        F.lit(BUDGET).alias("budget"),
    )


ENABLED = "scope <> 1"


def _scorer(pairs):
    """Word overlap that gives a fifth of the questions nothing, as a provider that fails."""
    return T.word_overlap(pairs.where("question % 5 <> 4"))


def _traced(spark, d, scorer=_scorer):
    return T.traced_retrieval(_chunks(spark, d), _questions(spark, d), POOL, scorer, LEAST_CHUNKS, ENABLED, _texts(spark, d), _placed(spark, d))


@query("r4_mode_routing", f"WITH {_SNAP_SQL} SELECT question, error, mode, domain, chunk_id, score, f.rank FROM (SELECT question, error, NULL AS mode FROM rt WHERE error IS NOT NULL UNION ALL SELECT question, NULL, mode FROM qs) LEFT JOIN (SELECT * FROM found) f USING (question)")
def r4(spark, d):
    """Every question with its error or mode, and the candidates of that mode."""
    routed = stored(T.route(_questions(spark, d), ENABLED))
    found = T.routed_search(_chunks(spark, d), routed, POOL, _texts(spark, d), _placed(spark, d))[0]
    return routed.select("question", "error", "mode").join(found, "question", "left").select("question", "error", "mode", "domain", "chunk_id", "score", "rank")


@query("r7_rerank", f"WITH {_RERANK_SQL} SELECT question, chunk_id, score, rank, domain, fits FROM sel")
def r7(spark, d):
    return _traced(spark, d)[0]


@query("r30_retrieval_trace", f"""WITH {_RERANK_SQL},
n AS (SELECT question, coalesce(held, 0) AS held, requested, text, mode, qs.scope AS scope FROM qs LEFT JOIN size_ USING (scope)),
a AS (SELECT question, count(*) AS c FROM near GROUP BY question), b AS (SELECT question, count(*) AS c FROM said GROUP BY question), f AS (SELECT question, count(*) AS c FROM found GROUP BY question),
p AS (SELECT question, count(*) AS c, count(*) FILTER (ready) AS ri, count(*) FILTER (judged) AS ro FROM pool GROUP BY question),
s AS (SELECT question, count(*) AS c, count(DISTINCT parent) AS parents, coalesce(sum(cost) FILTER (fits), 0) AS yes, coalesce(sum(cost) FILTER (NOT fits), 0) AS no, count(*) FILTER (NOT fits) AS cut, array_to_string(list_sort(list(DISTINCT generation)), ',') AS gens, any_value(domain) AS domain FROM sel GROUP BY question),
j AS (SELECT n.*, coalesce(a.c, 0) AS dense, coalesce(b.c, 0) AS lexical, coalesce(f.c, 0) AS fused, coalesce(p.c, 0) AS dedup, coalesce(ri, 0) AS ri, coalesce(ro, 0) AS ro, coalesce(s.c, 0) AS selected, coalesce(parents, 0) AS parents, coalesce(yes, 0) AS yes, coalesce(no, 0) AS no, coalesce(cut, 0) AS cut, coalesce(gens, '') AS gens, domain
  FROM n LEFT JOIN a USING (question) LEFT JOIN b USING (question) LEFT JOIN f USING (question) LEFT JOIN p USING (question) LEFT JOIN s USING (question)),
r AS (SELECT *, list_filter([CASE WHEN held = 0 THEN 'empty_corpus' END, CASE WHEN selected = 0 THEN 'no_candidates' END, CASE WHEN selected > 0 AND selected < requested AND selected < held THEN 'underfilled_top_k' END, CASE WHEN ri > 0 AND ro = 0 THEN 'reranker_failed' END,
  CASE WHEN selected < requested AND fused > dedup THEN 'dedup_shortfall' END, CASE WHEN cut > 0 THEN 'evidence_dropped_for_budget' END], lambda x: x IS NOT NULL) AS l FROM j)
SELECT question, CAST(scope AS BIGINT) AS scope, mode, substr(sha256(text), 1, 32) AS query_hash, domain AS score_domain, gens AS generation_ids, dense AS candidates_dense, lexical AS candidates_lexical, fused AS candidates_fused, dedup AS candidates_deduplicated,
  ri AS candidates_reranker_input, ro AS candidates_reranker_output, selected AS candidates_selected, parents AS unique_parents, CAST(yes AS BIGINT) AS tokens_selected, CAST(no AS BIGINT) AS tokens_dropped, CASE WHEN len(l) = 0 THEN 'ok' ELSE array_to_string(l, ',') END AS reasons FROM r""")
def r30(spark, d):
    return _traced(spark, d)[1]
