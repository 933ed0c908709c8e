"""Interaction logs, event streams and memories, mapped from events, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import memory as MEM, retrieval as R
from docloom.plans.registry import query, table
from docloom.streaming import events as EV

AS_OF = "TIMESTAMP_NTZ '2024-01-25 00:00:00'"
SQL_AS_OF = "TIMESTAMP '2024-01-25 00:00:00'"
SEQ_SQL = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events"


def logs(spark, d):
    feedback = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1)
    return table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("value") / 100).alias("relevance"), feedback.alias("feedback"))


@query("a2_log_metrics", f"""
SELECT user_id, count(*) AS total, count(*) FILTER (value / 100 > 0.5) AS good, round(avg(value / 100), 6) AS avg_relevance, count(*) FILTER (event_type = 'purchase') AS positive, count(*) FILTER (event_type = 'error') AS negative,
 round(100.0::DOUBLE * good / total, 6) AS success_rate, round(CASE WHEN positive + negative = 0 THEN 0 ELSE 100.0::DOUBLE * positive / (positive + negative) END, 6) AS positive_rate
FROM events WHERE ts > {SQL_AS_OF} - INTERVAL 14 DAY GROUP BY user_id""")
def a2(spark, d):
    return MEM.log_metrics(logs(spark, d), F.expr(AS_OF), 14, "user_id")


@query("a16_provider_metrics", "SELECT event_type, count(*) AS calls, round(avg(value), 6) AS avg_latency, min(value) AS min_latency, max(value) AS max_latency, round(avg(CASE WHEN value > 90 THEN 1.0::DOUBLE ELSE 0 END), 6) AS error_rate FROM events GROUP BY event_type")
def a16(spark, d):
    return MEM.provider_metrics(table(spark, d, "events"), "event_type", "value", F.col("value") > 90)


@query("d1_time_cutoff", f"SELECT event_id FROM events WHERE ts > {SQL_AS_OF} - INTERVAL 36 HOUR AND ts <= {SQL_AS_OF}")
def d1(spark, d):
    return table(spark, d, "events").where(f"ts > {AS_OF} - INTERVAL 36 HOUR AND ts <= {AS_OF}").select("event_id")


@query("d2_whole_days", f"SELECT event_id, CAST(floor(epoch({SQL_AS_OF} - ts) / 86400) AS BIGINT) AS days FROM events WHERE ts <= {SQL_AS_OF}")
def d2(spark, d):
    return table(spark, d, "events").where(f"ts <= {AS_OF}").select("event_id", F.timestamp_diff("DAY", F.col("ts"), F.expr(AS_OF)).cast("bigint").alias("days"))


@query("d3_rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def d3(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query("p5_limit_clamp", "SELECT event_id, least(greatest(CAST(floor(value * 10) AS BIGINT) - 100, 1), 500) AS lim FROM events")
def p5(spark, d):
    return table(spark, d, "events").select("event_id", F.least(F.greatest(F.floor(F.col("value") * 10) - 100, F.lit(1)), F.lit(500)).alias("lim"))


@query("p7_finite_scores", "SELECT event_type, count(*) FILTER (event_id % 17 = 0) AS rejected, count(*) FILTER (event_id % 17 <> 0 AND value / 100 >= 0.3) AS kept FROM events GROUP BY event_type")
def p7(spark, d):
    score = F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 100)
    finite = ~(F.isnan(score) | (F.abs(score) == float("inf")))
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(~finite).alias("rejected"), F.count_if(finite & (score >= 0.3)).alias("kept"))


@query("x1_sequence", SEQ_SQL.replace("*", "event_id, user_id", 1))
def x1(spark, d):
    return EV.sequence(table(spark, d, "events")).select("event_id", "user_id", "seq")


@query("x2_replay", f"SELECT user_id, event_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS age FROM ({SEQ_SQL})) WHERE age <= 20 AND seq > 15")
def x2(spark, d):
    return EV.replay(table(spark, d, "events"), 15, 20).select("user_id", "event_id", "seq")


@query("x3_missed_events", f"SELECT user_id, seq, coalesce(seq - lag(seq) OVER (PARTITION BY user_id ORDER BY seq) - 1, 0) AS missed FROM ({SEQ_SQL}) WHERE event_id % 3 <> 0")
def x3(spark, d):
    return EV.missed(EV.sequence(table(spark, d, "events")).where("event_id % 3 <> 0")).select("user_id", "seq", "missed")


@query("x5_progress", "SELECT conv_id, turn, CAST(count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations")
def x5(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    return table(spark, d, "conversations").select("conv_id", "turn", F.count("*").over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)).alias("done"), F.count("*").over(w).alias("total"))


@query("x7_latest_status", "SELECT user_id, max_by(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def x7(spark, d):
    return EV.latest_status(table(spark, d, "events"))


@query("x9_size_limited", "SELECT event_id, used FROM (SELECT event_id, CAST(sum(strlen(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM events) WHERE used <= 500")
def x9(spark, d):
    return EV.size_limited(table(spark, d, "events"), 500, F.octet_length("props")).select("event_id", "used")


@query("x10_sliding_load", "SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS cost FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)")
def x10(spark, d):
    return EV.sliding_load(table(spark, d, "events"), 6 * 3600).select("event_id", "requests", F.round("cost", 4).alias("cost"))


@query("x11_fixed_window", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def x11(spark, d):
    return EV.tumbling_counts(table(spark, d, "events"), 86_400)


@query("x4_stale_channels", f"WITH c AS (SELECT user_id, min(ts) AS created, max(ts) AS last_event, user_id % 3 AS subscribers FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT user_id FROM c WHERE {SQL_AS_OF} - created > INTERVAL 20 DAY OR (subscribers = 0 AND {SQL_AS_OF} - last_event > INTERVAL 1 DAY)")
def x4(spark, d):
    channels = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("created"), F.max("ts").alias("last_event")).withColumn("subscribers", F.col("user_id") % 3)
    return EV.stale_channels(channels, F.expr(AS_OF), 86_400, 20 * 86_400).select("user_id")


DAY_US = 86_400_000_000


@query("x12_circuit_breaker", f"""
WITH RECURSIVE t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, epoch_us(ts) AS tick, event_type NOT IN ('error', 'view') AS ok FROM events),
f AS (SELECT user_id, 0::BIGINT AS r, 0::BIGINT AS event_id, 'closed' AS state, 0::BIGINT AS opened, NULL::BIGINT AS since, 0 AS failed, 0 AS passed, true AS allowed FROM (SELECT DISTINCT user_id FROM t)
 UNION ALL
 SELECT user_id, r, event_id,
  CASE WHEN s = 'open' THEN 'open' WHEN s = 'half_open' THEN CASE WHEN NOT ok THEN 'open' WHEN p + 1 >= 2 THEN 'closed' ELSE 'half_open' END WHEN NOT ok AND n >= 2 THEN 'open' ELSE 'closed' END,
  CASE WHEN s <> 'open' AND NOT ok AND (s = 'half_open' OR n >= 2) THEN tick ELSE opened END,
  CASE WHEN s = 'closed' AND ok OR s = 'half_open' AND ok AND p + 1 >= 2 THEN NULL WHEN s = 'closed' THEN w ELSE since END,
  CASE WHEN s = 'closed' THEN CASE WHEN ok THEN 0 ELSE n END WHEN s = 'half_open' THEN 0 ELSE failed END,
  CASE WHEN s = 'half_open' AND ok AND p + 1 < 2 THEN p + 1 WHEN s = 'open' THEN passed ELSE 0 END,
  s <> 'open'
 FROM (SELECT *, CASE WHEN half THEN 'half_open' ELSE state END AS s, CASE WHEN half THEN 0 ELSE passed END AS p,
   CASE WHEN since IS NULL OR tick - since > 3 * {DAY_US} THEN tick ELSE since END AS w, CASE WHEN since IS NULL OR tick - since > 3 * {DAY_US} THEN 1 ELSE failed + 1 END AS n
  FROM (SELECT f.user_id, t.r, t.event_id, t.tick, t.ok, f.state, f.opened, f.since, f.failed, f.passed, f.state = 'open' AND t.tick - f.opened >= {DAY_US} AS half FROM f JOIN t ON t.user_id = f.user_id AND t.r = f.r + 1)))
SELECT user_id, event_id, state, allowed FROM f WHERE r > 0""")
def x12(spark, d):
    calls = table(spark, d, "events").select("user_id", "event_id", EV.micros("ts").alias("at"), (~F.col("event_type").isin("error", "view")).alias("ok"))
    return EV.circuit_states(calls, "user_id", EV.Breaker(failures=2, successes=2, open_for=86_400, window=3 * 86_400))


@query("x8_turn_rules", "SELECT conv_id, bool_or(role = 'assistant' AND before = 'assistant') AS repeated, max_by(role, turn) = 'assistant' AS ended FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY conv_id")
def x8(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy("conv_id").agg(F.bool_or(F.coalesce((F.col("role") == "assistant") & (F.col("before") == "assistant"), F.when(F.col("role") != "assistant", False))).alias("repeated"), (F.max_by("role", "turn") == "assistant").alias("ended"))


def memories(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("expertise", "goal", "preference", "summary", "fact"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("event_id").alias("memory_id"), "user_id", kinds.alias("kind"), (F.col("value") / 100).alias("salience"), F.col("ts").alias("updated_at"))


MEM_SQL = "mem AS (SELECT event_id AS memory_id, user_id, ['expertise', 'goal', 'preference', 'summary', 'fact'][CAST(event_id % 5 + 1 AS INT)] AS kind, value / 100 AS salience, ts AS updated_at FROM events)"


@query("m9_salience_decay", f"""WITH {MEM_SQL}, x AS (SELECT *, floor(epoch({SQL_AS_OF} - updated_at) / 86400) AS days FROM mem WHERE updated_at <= {SQL_AS_OF}),
y AS (SELECT *, CASE WHEN kind = 'summary' OR days < 7 THEN salience ELSE least(greatest(salience * pow(0.95, floor(days / 7)), 0), 1) END AS now FROM x)
SELECT memory_id, round(now, 9) AS salience, kind <> 'summary' AND now < 0.1 AS dropped FROM y""")
def m9(spark, d):
    return MEM.decay(memories(spark, d).where(f"updated_at <= {AS_OF}"), F.expr(AS_OF))


@query("r18_core_memories", f"WITH {MEM_SQL} SELECT user_id, memory_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY salience DESC, updated_at DESC, memory_id) AS INT) AS rank FROM mem WHERE kind IN ('expertise', 'goal', 'preference') AND salience > 0.5 QUALIFY rank <= 15")
def r18(spark, d):
    return MEM.core_memories(memories(spark, d), "user_id").select("user_id", "memory_id", "rank")


@query("r19_summary_retention", f"WITH {MEM_SQL} SELECT memory_id FROM mem QUALIFY kind <> 'summary' OR row_number() OVER (PARTITION BY user_id, kind ORDER BY updated_at DESC, memory_id DESC) <= 2")
def r19(spark, d):
    return MEM.keep_newest(memories(spark, d), "user_id", "summary", 2).select("memory_id")


@query("m10_memory_resolution", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS question, v.vec_id AS chunk_id, round(list_cosine_similarity(q.e, v.e), 6) AS score, (v.vec_id % 10) / 10.0::DOUBLE AS salience, (q.vec_id % 7) / 10.0::DOUBLE AS new_salience FROM v q JOIN v ON v.label = q.label AND q.vec_id % 100 = 0 AND v.vec_id % 20 <> 0),
b AS (SELECT question, new_salience, max_by((chunk_id, score, salience), (score, chunk_id)) AS b FROM (SELECT *, score AS sc FROM s) GROUP BY question, new_salience),
r AS (SELECT question, new_salience, b[1] AS chunk_id, b[2] AS score, b[3] AS salience FROM b)
SELECT question, CASE WHEN score > 0.97 THEN 'skip' WHEN score >= 0.9 THEN 'update' ELSE 'insert' END AS action, CASE WHEN score >= 0.9 THEN chunk_id ELSE -1 END AS target,
 round(CASE WHEN score BETWEEN 0.9 AND 0.97 THEN least((salience * 0.7 + new_salience * 0.3) * 1.05, 1) ELSE new_salience END, 6) AS salience FROM r""")
def m10(spark, d):
    from docloom.plans.retrieval_queries import vector_questions, vectors

    near = R.dense_topk(vectors(spark, d).where("chunk_id % 20 <> 0"), vector_questions(spark, d), 5)
    return MEM.resolve(near.withColumns({"salience": (F.col("chunk_id") % 10) / F.lit(10.0), "new_salience": (F.col("question") % 7) / F.lit(10.0)})).fillna(-1, ["target"])


@query("r15_prompt_budget", "SELECT doc_id, greatest(n_chars - greatest(1024, n_chars // 20) - 500 - 16, 0) AS allowance FROM documents")
def r15(spark, d):
    return table(spark, d, "documents").select("doc_id", MEM.budget(F.col("n_chars"), F.lit(500)).alias("allowance"))


@query("r16_evidence_fit", """
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, strlen(text) + 100 AS p, strlen(text) // 2 AS c FROM conversations),
f AS (SELECT conv_id, 0::BIGINT AS r, 0::BIGINT AS used, 0::BIGINT AS admitted, false AS stopped FROM (SELECT DISTINCT conv_id FROM conversations)
 UNION ALL SELECT f.conv_id, t.r, CASE WHEN f.stopped THEN used WHEN used + p <= 1200 THEN used + p WHEN used + c <= 1200 THEN used + c ELSE used END,
  CASE WHEN f.stopped THEN admitted WHEN used + p <= 1200 OR used + c <= 1200 THEN admitted + 1 ELSE admitted END, f.stopped OR (used + p > 1200 AND used + c > 1200) FROM f JOIN t ON t.conv_id = f.conv_id AND t.r = f.r + 1)
SELECT conv_id, max(admitted) AS admitted, max(used) AS used FROM f GROUP BY conv_id""")
def r16(spark, d):
    size = F.octet_length("text")
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("rank"), (size + 100).cast("bigint").alias("parent_cost"), F.floor(size / 2).cast("bigint").alias("child_cost"))
    return MEM.fit_evidence(rows, "conv_id", 1200)


@query("d4_json_field", "SELECT event_id, props->>'$.page' AS page, json_keys(props)[1] IS NOT NULL AS has_keys FROM events")
def d4(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), (F.size(F.json_object_keys("props")) > 0).alias("has_keys"))


@query("g11_retention", f"SELECT ts < {SQL_AS_OF} - INTERVAL 10 DAY AS expired, count(*) AS n FROM events GROUP BY 1")
def g11(spark, d):
    old = F.col("ts") < F.expr(f"{AS_OF} - INTERVAL 10 DAY")
    return table(spark, d, "events").groupBy(old.alias("expired")).agg(F.count("*").alias("n"))


@query("k10_list_order", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS pos FROM customer QUALIFY pos <= 15")
def k10(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(order).alias("pos")).where("pos <= 15")


@query("j5b_notebook_listing", "SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY source")
def j5b(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
