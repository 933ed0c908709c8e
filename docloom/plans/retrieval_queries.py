"""Batch retrieval and evaluation queries: vectors and text of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import evaluate as E, retrieval as R
from docloom.operators.stored import stored
from docloom.plans.registry import query, table

#: Questions: every vector whose id is divisible by 100, against all vectors.
POOL, LIMIT = 50, 10

VEC_SQL = f"""
v AS (SELECT vec_id AS chunk_id, CAST(label AS BIGINT) AS scope, vec_id // 4 AS parent, embedding::DOUBLE[] AS e FROM embeddings),
sim AS (SELECT q.chunk_id AS question, v.chunk_id, v.parent, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v JOIN v q ON q.chunk_id % 100 = 0 AND q.scope = v.scope),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk_id) AS INT) AS rank FROM sim QUALIFY rank <= {POOL})"""
TOK_SQL = r"list_filter(string_split(lower(trim(regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))), ' '), lambda t: t <> '')"
LEX_SQL = f"""
ch AS (SELECT doc_id AS chunk_id, {TOK_SQL.format('text')} AS tokens FROM documents),
qs AS (SELECT item_id AS question, unnest({TOK_SQL.format('text')}) AS term FROM benchmark),
terms AS (SELECT question, term, count(*) AS times FROM qs GROUP BY question, term),
st AS (SELECT count(*) AS n, greatest(avg(len(tokens)), 1.0) AS mean FROM ch),
w AS (SELECT chunk_id, len(tokens) AS length, unnest(tokens) AS term FROM ch),
hits AS (SELECT term, chunk_id, length, count(*) AS tf FROM w WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
bm AS (SELECT question, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * times * tf * ({R.K1} + 1) / (tf + {R.K1} * (1 - {R.B} + {R.B} * length / mean))), 6) AS score
  FROM hits JOIN terms USING (term) JOIN df USING (term), st GROUP BY question, chunk_id)"""
RANK = "row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk_id)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("scope"), "embedding", F.floor(F.col("vec_id") / 4).alias("parent"))


def vector_questions(spark, d):
    return vectors(spark, d).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("question"), "scope", "embedding")


def dense(spark, d, k=POOL):
    found = R.dense_topk(vectors(spark, d), vector_questions(spark, d), k)
    return found.join(vectors(spark, d).select("chunk_id", "parent"), "chunk_id")


def text_chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), X.lexical_tokens(F.col("text")).alias("tokens"))


def text_questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question"), X.lexical_tokens(F.col("text")).alias("tokens"))


@query("k1_dense_topk", f"WITH {VEC_SQL} SELECT question, chunk_id, score, rank FROM dense")
def k1(spark, d):
    return R.dense_topk(vectors(spark, d), vector_questions(spark, d), POOL)


@query("r1_dense_search_min_score", f"WITH {VEC_SQL} SELECT question, chunk_id, least(greatest(score, 0), 1) AS score FROM dense WHERE rank <= {LIMIT} AND score >= 0.2")
def r1(spark, d):
    return R.select_final(dense(spark, d), LIMIT).where("score >= 0.2").select("question", "chunk_id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


@query("w2_parent_collapse", f"""WITH {VEC_SQL}, f AS (SELECT *, min(rank) OVER (PARTITION BY question, parent) AS best FROM dense)
SELECT question, min_by(chunk_id, rank) AS chunk_id, parent, coalesce(array_to_string(list(chunk_id ORDER BY rank) FILTER (rank <> best), ','), '') AS absorbed, CAST(row_number() OVER (PARTITION BY question ORDER BY min(rank)) AS INT) AS rank
FROM f GROUP BY question, parent""")
def w2(spark, d):
    return R.collapse_parents(dense(spark, d)).select("question", "chunk_id", "parent", F.array_join(F.transform("absorbed", lambda x: x.cast("string")), ",").alias("absorbed"), "rank")


@query("k6_sandwich", f"WITH {VEC_SQL} SELECT question, chunk_id, CAST(CASE WHEN rank = 1 THEN 1 WHEN rank = 2 THEN n ELSE rank - 1 END AS BIGINT) AS position FROM (SELECT *, count(*) OVER (PARTITION BY question) AS n FROM dense WHERE rank <= {LIMIT})")
def k6(spark, d):
    return R.sandwich(R.select_final(dense(spark, d), LIMIT)).select("question", "chunk_id", "position")


@query("k4_preference_order", f"WITH {VEC_SQL} SELECT question, chunk_id, CASE WHEN parent % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN chunk_id % 3 = 0 THEN 1 ELSE 0 END AS tier, CAST(row_number() OVER (PARTITION BY question ORDER BY round(score, 1) DESC, tier DESC, chunk_id) AS INT) AS rank FROM dense")
def k4(spark, d):
    return R.prefer(dense(spark, d).withColumn("score", F.round("score", 1)), F.col("parent") % 2 == 0, F.col("chunk_id") % 3 == 0).select("question", "chunk_id", "tier", "rank")


@query("m5_bm25", f"WITH {LEX_SQL} SELECT question, chunk_id, score FROM bm QUALIFY {RANK} <= {LIMIT}")
def m5(spark, d):
    return R.lexical_topk(text_chunks(spark, d), text_questions(spark, d), LIMIT).select("question", "chunk_id", "score")


@query("a9_document_frequency", f"WITH {LEX_SQL} SELECT term, df, n, round(mean, 6) AS mean FROM df, st")
def a9(spark, d):
    chunks = text_chunks(spark, d)
    terms = text_questions(spark, d).select(F.explode("tokens").alias("term")).distinct()
    df = chunks.select(F.explode(F.array_distinct("tokens")).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(chunks.agg(F.count("*").alias("n"), F.round(F.greatest(F.avg(F.size("tokens")), F.lit(1.0)), 6).alias("mean"))))


@query("p2_all_terms_match", f"""WITH {LEX_SQL}, need AS (SELECT question, count(*) AS need FROM terms GROUP BY question)
SELECT question, chunk_id FROM hits JOIN terms USING (term) JOIN need USING (question) GROUP BY question, chunk_id, need HAVING count(*) = need""")
def p2(spark, d):
    return R.all_terms(text_chunks(spark, d), text_questions(spark, d))


#: One snapshot of chunks: all documents, with the vectors of equal id where there are some. The questions are all benchmark items.
MIN_FUSED = 0.004
SNAP_SQL = rf"""
hc AS (SELECT doc_id AS chunk_id, coalesce(label, doc_id) % 3 AS scope, doc_id // 4 AS parent, embedding::DOUBLE[] AS e, {TOK_SQL.format('text')} AS tokens FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
hq AS (SELECT item_id AS question, coalesce(label, item_id) % 3 AS scope, embedding::DOUBLE[] AS e, {TOK_SQL.format('text')} AS tokens FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
sim AS (SELECT question, chunk_id, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM hc c JOIN hq q USING (scope) WHERE c.e IS NOT NULL AND q.e IS NOT NULL),
terms AS (SELECT question, scope, term, count(*) AS times FROM (SELECT question, scope, unnest(tokens) AS term FROM hq) GROUP BY ALL),
st AS (SELECT count(*) AS n, greatest(avg(len(tokens)), 1.0) AS mean FROM hc),
hits AS (SELECT term, chunk_id, scope, length, count(*) AS tf FROM (SELECT chunk_id, scope, len(tokens) AS length, unnest(tokens) AS term FROM hc) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
bm AS (SELECT question, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * times * tf * ({R.K1} + 1) / (tf + {R.K1} * (1 - {R.B} + {R.B} * length / mean))), 6) AS score
  FROM hits JOIN terms USING (term, scope) JOIN df USING (term), st GROUP BY question, chunk_id),
ra AS (SELECT question, chunk_id, {RANK} AS rank FROM sim QUALIFY rank <= {POOL}),
rb AS (SELECT question, chunk_id, {RANK} AS rank FROM bm QUALIFY rank <= {POOL}),
fused AS (SELECT question, chunk_id, round(sum(part), 6) AS score FROM (SELECT question, chunk_id, 1.0::DOUBLE / (60 + rank) AS part FROM ra UNION ALL SELECT question, chunk_id, 0.25::DOUBLE / (60 + rank) FROM rb) GROUP BY question, chunk_id),
found AS (SELECT question, chunk_id, score, CAST({RANK} AS INT) AS rank FROM fused)"""


def snapshot(spark, d):
    """All documents as chunks without their texts, stored once as the vector ranking and what follows both rankings read it."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    docs = table(spark, d, "documents").select("doc_id").join(v.hint("merge"), "doc_id", "left")
    return stored(docs.select(F.col("doc_id").alias("chunk_id"), (F.coalesce("label", "doc_id") % 3).alias("scope"), F.floor(F.col("doc_id") / 4).alias("parent"), "embedding"))


def snapshot_scopes(spark, d):
    """Adds the scopes of ``snapshot`` to rows of chunks, one row for each vector of equal id there too."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("label"))
    return lambda rows: rows.join(v.hint("merge"), "chunk_id", "left").withColumn("scope", F.coalesce("label", "chunk_id") % 3).drop("label")


def snapshot_questions(spark, d):
    """All benchmark items, with the vectors of equal id."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    items = table(spark, d, "benchmark").select("item_id", X.lexical_tokens(F.col("text")).alias("tokens"))
    return stored(items.join(v, "item_id", "left").select(F.col("item_id").alias("question"), (F.coalesce("label", "item_id") % 3).alias("scope"), "embedding", "tokens"))


def hybrid(spark, d, chunks, limit=LIMIT, min_relevance=0.0):
    """The flagship: a vector and a lexical ranking over one snapshot of chunks, fused by rank."""
    return R.hybrid_search(chunks, snapshot_questions(spark, d), POOL, limit, min_relevance, text_chunks(spark, d), snapshot_scopes(spark, d))


@query("r3_hybrid_search", f"WITH {SNAP_SQL} SELECT * FROM found WHERE rank <= {LIMIT} AND score >= {MIN_FUSED}")
def r3(spark, d):
    return hybrid(spark, d, snapshot(spark, d), LIMIT, MIN_FUSED).select("question", "chunk_id", "score", "rank")


@query("r2_lexical_search", f"WITH {SNAP_SQL} SELECT question, chunk_id, score, CAST({RANK} AS INT) AS rank FROM bm WHERE (question, chunk_id) IN (SELECT question, chunk_id FROM (SELECT DISTINCT question, scope, term FROM terms) JOIN hits USING (term, scope) JOIN (SELECT question, count(*) AS need FROM terms GROUP BY question) USING (question) GROUP BY question, chunk_id, need HAVING count(*) = need) QUALIFY rank <= {LIMIT}")
def r2(spark, d):
    return R.lexical_topk(text_chunks(spark, d), snapshot_questions(spark, d).withColumn("strict", F.lit(True)), LIMIT, placed=snapshot_scopes(spark, d)).select("question", "chunk_id", "score", "rank")


#: Places of the words of each question in each chunk that has them all, then the earliest of the words' last places at each place.
COVER_SQL = f"""WITH {LEX_SQL},
qt AS (SELECT DISTINCT question, term FROM qs),
need AS (SELECT question, count(*) AS n FROM qt GROUP BY question),
full_ AS (SELECT question, chunk_id, n FROM hits JOIN qt USING (term) JOIN need USING (question) GROUP BY question, chunk_id, n HAVING count(*) = n),
occ AS (SELECT question, chunk_id, n, term, pos FROM full_ JOIN (SELECT chunk_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM ch) USING (chunk_id) JOIN qt USING (question, term)),
held AS (SELECT *, row_number() OVER (PARTITION BY question, chunk_id ORDER BY pos) AS i FROM occ),
seen AS (SELECT a.question, a.chunk_id, a.i, a.pos, a.n, b.term, max(b.i) AS last FROM held a JOIN held b ON a.question = b.question AND a.chunk_id = b.chunk_id AND b.i <= a.i GROUP BY ALL),
beg AS (SELECT question, chunk_id, i, pos, CASE WHEN count(*) = n THEN min(last) ELSE 0 END AS b FROM seen GROUP BY question, chunk_id, i, pos, n),
cov AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY question, chunk_id ORDER BY i) AS before FROM beg)
SELECT c.question, c.chunk_id, round(sum(0.1::DOUBLE / (1 + c.pos - h.pos - (c.i - h.i))), 6) AS score
FROM cov c JOIN held h ON h.question = c.question AND h.chunk_id = c.chunk_id AND h.i = c.b WHERE c.b > c.before GROUP BY c.question, c.chunk_id"""


@query("m4_cover_density", COVER_SQL)
def m4(spark, d):
    """Cover density of all words of every benchmark item in every document that holds them all."""
    return R.cover_density(text_chunks(spark, d), text_questions(spark, d).where(F.size("tokens") > 0))


@query("r6_retrieval_pipeline", f"""WITH {SNAP_SQL},
one AS (SELECT question, min_by(chunk_id, f.rank) AS chunk_id, min_by(f.score, f.rank) AS score FROM found f JOIN hc USING (chunk_id) GROUP BY question, hc.parent),
o AS (SELECT question, chunk_id, score, CASE WHEN scope % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN chunk_id % 3 = 0 THEN 1 ELSE 0 END AS tier FROM one JOIN hc USING (chunk_id)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, tier DESC, chunk_id) AS INT) AS rank, count(*) OVER (PARTITION BY question) AS candidates FROM o),
s AS (SELECT *, count(*) OVER (PARTITION BY question) AS n FROM ranked WHERE rank <= {LIMIT})
SELECT question, chunk_id, score, rank, CAST(CASE WHEN n < 3 OR rank = 1 THEN rank WHEN rank = 2 THEN n ELSE rank - 1 END AS BIGINT) AS position,
  CASE WHEN n < {LIMIT} AND candidates > n THEN 'underfilled' ELSE 'sufficient' END AS verdict FROM s""")
def r6(spark, d):
    chunks = snapshot(spark, d)
    return R.retrieve(hybrid(spark, d, chunks, 2 * POOL), chunks.select("chunk_id", "parent", "scope"), F.col("scope") % 2 == 0, F.col("chunk_id") % 3 == 0, LIMIT)


#: Judgments are planted within blocks of 500 vectors, so their number grows with the questions; a fifth of the questions has none, a quarter no sources.
_MEANS = ", ".join(f"round(coalesce(avg({c}), 0), 6) AS {c}" for c in E.MEANS)
EVAL_SQL = f"""{VEC_SQL}, res AS (SELECT question, chunk_id, parent, chunk_id // 32 AS source, rank FROM dense WHERE rank <= 20),
qs AS (SELECT chunk_id AS question, scope, chunk_id // 100 AS n, ['factual', 'multi_hop', 'unanswerable'][chunk_id // 100 % 3 + 1] AS category FROM v WHERE chunk_id % 100 = 0),
rel AS (SELECT question, n, chunk_id, chunk_id // 32 AS source FROM qs JOIN v USING (scope) WHERE chunk_id // 500 = question // 500 AND chunk_id % 7 = 0 AND n % 5 <> 4),
src AS (SELECT DISTINCT question, source FROM rel WHERE n % 4 <> 3),
bar AS (SELECT question, question // 32 + unnest([1, 2, 3]) AS source FROM qs WHERE n % 3 = 0),
marked AS (SELECT question, chunk_id, source, parent, rank, (question, chunk_id) IN (SELECT question, chunk_id FROM rel) AS hit, (question, source) IN (SELECT question, source FROM src) AS wanted, (question, source) IN (SELECT question, source FROM bar) AS barred FROM res),
m AS (SELECT question, category, n_relevant, n_sources, count(*) FILTER (hit AND rank <= 5) AS h5, count(*) FILTER (hit AND rank <= 10) AS h10, count(*) FILTER (hit AND rank <= 20) AS h20, min(rank) FILTER (hit) AS first,
  coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 10), 0) AS dcg, count(rank) AS returned, count(DISTINCT parent) AS parents, count(DISTINCT source) FILTER (wanted) AS sources, count(*) FILTER (barred) AS breaches
  FROM qs LEFT JOIN marked USING (question) LEFT JOIN (SELECT question, count(DISTINCT chunk_id) AS n_relevant FROM rel GROUP BY question) USING (question) LEFT JOIN (SELECT question, count(*) AS n_sources FROM src GROUP BY question) USING (question) GROUP BY ALL),
metrics AS (SELECT question, category, round(h5 / n_relevant, 6) AS recall_5, round(h10 / n_relevant, 6) AS recall_10, round(h20 / n_relevant, 6) AS recall_20, CASE WHEN n_relevant > 0 THEN round(coalesce(1 / first, 0), 6) END AS rr,
  CASE WHEN n_relevant > 0 THEN round(dcg / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 6) END AS ndcg_10, round(sources / n_sources, 6) AS source_recall,
  round(CASE WHEN returned = 0 THEN 0 ELSE (returned - parents) / returned END, 6) AS duplicate_parents, round(least(returned / 20.0::DOUBLE, 1), 6) AS fill, breaches > 0 AS isolation_breach,
  list_filter([CASE WHEN returned = 0 THEN 'no_candidates' END, CASE WHEN returned > 0 AND returned < 20 THEN 'underfilled_top_k' END, CASE WHEN parents < returned THEN 'dedup_shortfall' END, CASE WHEN category <> 'unanswerable' AND n_relevant IS NULL THEN 'missing_judgment' END, CASE WHEN breaches > 0 THEN 'isolation_breach' END], lambda x: x IS NOT NULL) AS l FROM m),
pops AS (SELECT population, count(*) AS queries, count(recall_10) AS judged_queries, {_MEANS}, count(*) FILTER (isolation_breach) AS isolation_failures FROM (SELECT *, unnest(['overall', 'category.' || category]) AS population FROM metrics) GROUP BY population)"""


def retrieval_metrics(spark, d):
    v = vectors(spark, d)
    n = F.floor(F.col("question") / 100)
    questions = vector_questions(spark, d).select("question", "scope", n.alias("n"), F.get(F.array(*map(F.lit, ("factual", "multi_hop", "unanswerable"))), (n % 3).cast("int")).alias("category"))
    chunks = v.where("chunk_id % 7 = 0").select("scope", "chunk_id", F.floor(F.col("chunk_id") / 500).alias("block"))
    relevant = questions.where("n % 5 <> 4").withColumn("block", F.floor(F.col("question") / 500)).join(chunks, ["scope", "block"])
    source = lambda c: F.floor(F.col(c) / 32)
    sources = relevant.where("n % 4 <> 3").select("question", source("chunk_id").alias("source"))
    forbidden = questions.where("n % 3 = 0").select("question", F.explode(F.array(*(source("question") + k for k in (1, 2, 3)))).alias("source"))
    asked = questions.select("question", "category", (F.col("category") != "unanswerable").alias("answerable"), F.lit(20).alias("requested"))
    results = R.select_final(dense(spark, d), 20).withColumn("source", source("chunk_id"))
    return E.evaluate(asked, results, relevant.select("question", "chunk_id"), sources, forbidden)


@query("r25_retrieval_metrics", f"WITH {EVAL_SQL} SELECT * EXCLUDE (l), CASE WHEN len(l) = 0 THEN 'ok' ELSE array_to_string(l, ',') END AS reasons FROM metrics")
def r25(spark, d):
    return retrieval_metrics(spark, d)


@query("a12_mean_metrics", f"WITH {EVAL_SQL} SELECT * FROM pops")
def a12(spark, d):
    return E.populations(retrieval_metrics(spark, d))


@query("r26_regression_gate", f"""WITH {EVAL_SQL},
later AS (SELECT population, judged_queries, isolation_failures, recall_10 + CASE WHEN population = 'category.factual' THEN 0.1 ELSE 0 END AS recall_10, ndcg_10 - CASE WHEN population = 'overall' THEN 0.05 ELSE 0 END AS ndcg_10 FROM pops WHERE population <> 'category.multi_hop'),
d AS (SELECT population, unnest([{{'m': 'recall_10', 'x': a.recall_10, 'y': b.recall_10}}, {{'m': 'ndcg_10', 'x': a.ndcg_10, 'y': b.ndcg_10}}], recursive := true) FROM pops a JOIN later b USING (population) WHERE population = 'overall' OR a.judged_queries > 0 OR b.judged_queries > 0)
SELECT 'incomparable' AS kind, 'requested_limit' AS metric, NULL::DOUBLE AS previous, NULL::DOUBLE AS current, NULL::DOUBLE AS delta, true AS blocking
UNION ALL SELECT 'missing_metric', population, NULL, NULL, NULL, true FROM pops WHERE population = 'category.multi_hop'
UNION ALL SELECT CASE WHEN y < x THEN 'regression' ELSE 'improvement' END, population || '.' || m, x, y, round(y - x, 6), y < x FROM d WHERE abs(round(y - x, 6)) > {E.TOLERANCE}
UNION ALL SELECT 'isolation_failure', population, NULL, isolation_failures, NULL, true FROM later WHERE isolation_failures > 0
UNION ALL SELECT 'unmet_target', 'overall.recall_10', {E.TARGETS['recall_10']}, recall_10, round(recall_10 - {E.TARGETS['recall_10']}, 6), false FROM later WHERE population = 'overall' AND recall_10 < {E.TARGETS['recall_10']}
UNION ALL SELECT 'unmet_target', 'overall.ndcg_10', {E.TARGETS['ndcg_10']}, ndcg_10, round(ndcg_10 - {E.TARGETS['ndcg_10']}, 6), false FROM later WHERE population = 'overall' AND ndcg_10 < {E.TARGETS['ndcg_10']}""")
def r26(spark, d):
    """The run against itself with planted changes: a fall, a rise, a population that is gone and another limit."""
    now = stored(E.populations(retrieval_metrics(spark, d)))
    change = lambda c, by, name: (F.col(c) + F.when(F.col("population") == name, by).otherwise(0.0)).alias(c)
    later = now.where("population <> 'category.multi_hop'").withColumns({"recall_10": change("recall_10", 0.1, "category.factual"), "ndcg_10": change("ndcg_10", -0.05, "overall")})
    size = vectors(spark, d).agg(F.count("*").cast("string").alias("size"))
    settings = lambda limit: size.select(F.inline(F.array(F.struct(F.lit("corpus_size").alias("field"), F.col("size").alias("value")), F.struct(F.lit("requested_limit").alias("field"), F.lit(limit).alias("value")))))
    return E.compare(now, later, settings("20"), settings("10"))


@query("r8_sufficiency", f"WITH {VEC_SQL} SELECT question, CASE WHEN count(*) FILTER (score > 0.3) = 0 THEN 'no_candidates' WHEN least(count(*) FILTER (score > 0.3), 3) < 5 AND count(*) FILTER (score > 0.3) > 3 THEN 'underfilled' ELSE 'sufficient' END AS verdict FROM dense GROUP BY question")
def r8(spark, d):
    n = F.count_if(F.col("score") > 0.3)
    return dense(spark, d).groupBy("question").agg(R.verdict(n, F.least(n, F.lit(3)), F.lit(5)).alias("verdict"))


@query("m1_cosine_similarity", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 10")
def m1(spark, d):
    v = table(spark, d, "embeddings")
    other = v.select(F.col("vec_id").alias("base"), F.col("embedding").alias("other"))
    return v.withColumn("base", F.col("vec_id") - F.col("vec_id") % 10).join(other, "base").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))
