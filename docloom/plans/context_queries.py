"""Stuffing decisions and corrective retrieval, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import context as C, retrieval as R
from docloom.plans.registry import query, table
from docloom.plans.retrieval_queries import LIMIT, TOK_SQL, text_chunks, text_questions

_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_STUFF_SQL = rf"""
ch AS (SELECT doc_id // 40 AS scope, doc_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN doc_id % 50 END AS page, text FROM documents),
st AS (SELECT scope, count(*) AS chunks, least([0, 30, 50, 95, 150][CAST(scope % 5 AS INT) + 1], [15, 40, 80][CAST(scope % 3 AS INT) + 1]) AS allowed, 60000 + 20000 * (scope % 7) AS budget FROM ch GROUP BY scope),
pr AS (SELECT ch.*, CAST(row_number() OVER (PARTITION BY scope ORDER BY doc_id) AS INT) AS i FROM ch JOIN st USING (scope) WHERE chunks <= allowed),
co AS (SELECT *, strlen('<source index="' || i || '" source_id="' || doc_id || '" title="' || {_ESCAPED.format('source')} || '"' || CASE WHEN page IS NULL THEN '' ELSE ' page="' || page || '"' END || '>' || chr(10) || '<content>' || chr(10)
   || {_ESCAPED.format("regexp_replace(text, '^[[:space:]]+|[[:space:]]+$', '', 'g')")} || chr(10) || '</content>' || chr(10) || '</source>' || chr(10) || chr(10)) + 1 AS cost FROM pr),
de AS (SELECT scope, chunks, c AS cost, CASE WHEN c IS NULL THEN 'searched' WHEN c > budget THEN 'over_budget' ELSE 'stuffed' END AS decision FROM st LEFT JOIN (SELECT scope, CAST(sum(cost) AS BIGINT) + {C.REGION_COST} AS c FROM co GROUP BY scope) USING (scope))"""


def stuffed(spark, d):
    """Scopes of forty documents each, under five models, three requests and seven budgets."""
    s = F.col("scope")
    chunks = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 40).alias("scope"), F.col("doc_id").alias("source_id"), F.col("source").alias("title"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 50).alias("page"), F.col("text").alias("body"))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (s % len(values)).cast("int"))
    settings = chunks.select("scope").distinct().select("scope", pick([0, 30, 50, 95, 150]).alias("threshold"), pick([15, 40, 80]).alias("requested"), (60_000 + 20_000 * (s % 7)).alias("budget"))
    return C.stuff_scopes(chunks, settings, ["source_id"])


@query("r5_context_stuffing", f"WITH {_STUFF_SQL} SELECT * FROM de")
def r5(spark, d):
    return stuffed(spark, d)[0]


@query("r17_entry_cost", f"WITH {_STUFF_SQL} SELECT scope, doc_id AS source_id, i AS index, CAST(cost AS BIGINT) AS cost, CAST(strlen(source) + strlen(regexp_replace(text, '^[[:space:]]+|[[:space:]]+$', '', 'g')) + {C.NATIVE_ENVELOPE} AS BIGINT) AS native_cost FROM co SEMI JOIN (SELECT scope FROM de WHERE decision = 'stuffed') USING (scope)")
def r17(spark, d):
    """What each chunk of a stuffed scope costs in the prompt, and as a document of its own."""
    found = stuffed(spark, d)[1]
    native = C.entry_cost(F.col("index"), F.col("source_id"), F.col("title"), F.col("page"), F.col("body"), native=True)
    return found.select("scope", "source_id", "index", F.col("cost").cast("long").alias("cost"), native.cast("long").alias("native_cost"))


ENOUGH = 3


def _pass_sql(q: str, p: str) -> str:
    """Common table expressions: the ranked results of the questions ``q`` (question, scope, tokens) and their counts."""
    return f"""
{p}t AS (SELECT question, scope, term, count(*) AS times FROM (SELECT question, scope, unnest(tokens) AS term FROM {q}) GROUP BY ALL),
{p}h AS (SELECT term, chunk_id, scope, length, count(*) AS tf FROM (SELECT chunk_id, scope, len(tokens) AS length, unnest(tokens) AS term FROM ch) WHERE term IN (SELECT term FROM {p}t) GROUP BY ALL),
{p}d AS (SELECT term, count(*) AS df FROM {p}h GROUP BY term),
{p}b AS (SELECT question, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * times * tf * ({R.K1} + 1) / (tf + {R.K1} * (1 - {R.B} + {R.B} * length / mean))), 6) AS score, count(DISTINCT term) AS have
  FROM {p}h JOIN {p}t USING (term, scope) JOIN {p}d USING (term), st GROUP BY question, chunk_id),
{p}r AS (SELECT question, chunk_id, chunk_id // 4 AS parent, score, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk_id) AS INT) AS rank FROM {p}b JOIN (SELECT question, count(*) AS need FROM {p}t GROUP BY question) USING (question) WHERE have = need QUALIFY rank <= {LIMIT}),
{p}c AS (SELECT q.question, coalesce(selected, 0) AS selected, coalesce(parents, 0) AS parents, coalesce(selected, 0) < least(held, {LIMIT}) AS underfilled FROM {q} q JOIN (SELECT scope, count(*) AS held FROM ch GROUP BY scope) USING (scope) LEFT JOIN (SELECT question, count(*) AS selected, count(DISTINCT parent) AS parents FROM {p}r GROUP BY question) USING (question))"""


_CORRECT_SQL = f"""
ch AS (SELECT doc_id AS chunk_id, doc_id % 2 AS scope, {TOK_SQL.format('text')} AS tokens FROM documents),
st AS (SELECT count(*) AS n, greatest(avg(len(tokens)), 1.0) AS mean FROM ch),
it AS (SELECT item_id AS question, item_id % 2 AS scope, {TOK_SQL.format('text')} AS w FROM benchmark),
q1 AS (SELECT question, scope, w[1:5] AS tokens FROM it), {_pass_sql('q1', 'a_')},
q2 AS (SELECT question, it.scope, CASE WHEN question % 3 = 0 THEN w[-3:] ELSE w[1:2] END AS tokens FROM it JOIN a_c USING (question) WHERE parents < {ENOUGH} AND question % 5 <> 4), {_pass_sql('q2', 'b_')},
turns AS (SELECT a.question, CASE WHEN better THEN b.selected ELSE a.selected END AS selected, CASE WHEN better THEN b.parents ELSE a.parents END AS parents, CASE WHEN better THEN b.underfilled ELSE a.underfilled END AS underfilled,
  CASE WHEN a.parents >= {ENOUGH} THEN 'kept' WHEN b.question IS NULL THEN 'skipped' WHEN better THEN 'corrected' ELSE 'retried' END AS outcome
  FROM a_c a LEFT JOIN (SELECT b_c.*, b_c.parents >= {ENOUGH} OR b_c.parents > a_c.parents AS better FROM b_c JOIN a_c USING (question)) b USING (question))"""


def corrective(spark, d):
    """Questions are the first five words of every benchmark item, which a document of the scope must all have; four fifths have another wording."""
    chunks = text_chunks(spark, d).withColumn("scope", F.col("chunk_id") % 2)
    items = text_questions(spark, d).withColumn("scope", F.col("question") % 2)
    first = items.withColumn("tokens", F.slice("tokens", 1, 5))
    other = F.when(F.col("question") % 3 == 0, F.slice("tokens", F.greatest(F.size("tokens") - 2, F.lit(1)), F.lit(3))).otherwise(F.slice("tokens", 1, 2))
    rewritten = items.where("question % 5 <> 4").select("question", other.alias("tokens"))
    corpus = chunks.groupBy("scope").agg(F.count("*").alias("held"))

    def search(questions):
        found = R.lexical_topk(chunks, questions.withColumn("strict", F.lit(True)), LIMIT)
        return found.withColumn("parent", F.floor(F.col("chunk_id") / 4))

    return C.corrective_retrieval(first, rewritten, corpus, search, LIMIT, ENOUGH)


@query("r10_corrective_retrieval", f"WITH {_CORRECT_SQL} SELECT question, chunk_id, score, rank, 1 AS pass FROM a_r WHERE question NOT IN (SELECT question FROM turns WHERE outcome = 'corrected') UNION ALL SELECT question, chunk_id, score, rank, 2 FROM b_r WHERE question IN (SELECT question FROM turns WHERE outcome = 'corrected')")
def r10(spark, d):
    return corrective(spark, d)[0].select("question", "chunk_id", "score", "rank", "pass")


@query("r9_underfill", f"WITH {_CORRECT_SQL} SELECT question, selected, parents, parents >= {ENOUGH} AS sufficient, underfilled, outcome FROM turns")
def r9(spark, d):
    return corrective(spark, d)[1]
