"""Scans, joins, aggregates, windows, pages and generation lifecycle over the engine's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from docloom.operators import lifecycle as L
from docloom.plans import model as M
from docloom.plans.model import MODEL_SQL
from docloom.functions import text as X
from docloom.plans.registry import query, table

AS_OF = "TIMESTAMP '2024-01-12 00:00:00'"


def over_model(name: str, sql: str):
    return query(name, f"WITH {MODEL_SQL} {sql}")


def active_chunks(spark, d):
    s = M.sources(spark, d)
    return M.chunks(spark, d).join(s, "source_id").where("generation_id = active_generation_id")


@over_model("j1_active_generation_join", "SELECT notebook_id, count(*) AS n, sum(length(content)) AS chars FROM chunks JOIN srcs USING (source_id) WHERE generation_id = active_generation_id GROUP BY notebook_id")
def j1(spark, d):
    return active_chunks(spark, d).groupBy("notebook_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@over_model("j2_fingerprint_join", "SELECT count(*) AS n FROM chunks JOIN srcs USING (source_id) JOIN gens USING (generation_id) WHERE generation_id = active_generation_id AND fingerprint = 'emb:v1'")
def j2(spark, d):
    return active_chunks(spark, d).join(M.generations(spark, d).select("generation_id", "fingerprint"), "generation_id").where("fingerprint = 'emb:v1'").agg(F.count("*").alias("n"))


@over_model("j3_owner_join", "SELECT s.source_id, s.notebook_id FROM srcs s JOIN notebooks n ON n.notebook_id = s.notebook_id AND n.owner = 2")
def j3(spark, d):
    return M.sources(spark, d).join(M.notebooks(spark, d).where("owner = 2"), "notebook_id").select("source_id", "notebook_id")


@over_model("j4_compatibility_count", "SELECT notebook_id, count(*) AS incompatible FROM srcs LEFT JOIN gens ON generation_id = active_generation_id WHERE fingerprint IS NULL OR fingerprint <> 'emb:v1' GROUP BY notebook_id")
def j4(spark, d):
    g = M.generations(spark, d).select(F.col("generation_id").alias("active_generation_id"), "fingerprint")
    return M.sources(spark, d).join(g, "active_generation_id", "left").where("fingerprint IS NULL OR fingerprint <> 'emb:v1'").groupBy("notebook_id").agg(F.count("*").alias("incompatible"))


@query("j5_left_join_count", "SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(sum(o_totalprice), 0) > 0 AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j5(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))  # counted before the join
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), (F.coalesce("s", F.lit(0)) > 0).alias("spent"))


@over_model("j6_embedding_reuse", """
, old AS (SELECT sha256(content) AS h, max((generation_id, chunk_index)) AS reuse FROM chunks JOIN srcs USING (source_id) WHERE generation_id = active_generation_id AND length(content) > 0 GROUP BY 1)
SELECT c.generation_id, c.chunk_index, reuse IS NOT NULL AS reused FROM chunks c LEFT JOIN old ON h = sha256(content) WHERE c.generation_id LIKE '%-1'""".lstrip())
def j6(spark, d):
    new = M.chunks(spark, d).where("generation_id LIKE '%-1'")
    return L.reusable_embeddings(new, active_chunks(spark, d)).select("generation_id", "chunk_index", F.col("reuse").isNotNull().alias("reused"))


ROLLBACK_SQL = """targets AS (SELECT source_id, target FROM (SELECT s.source_id, g.generation_id AS target, row_number() OVER (PARTITION BY s.source_id ORDER BY g.created_at DESC, g.generation_id DESC) AS r
  FROM srcs s JOIN gens a ON a.generation_id = s.active_generation_id JOIN gens g ON g.source_id = s.source_id AND g.state = 'published' AND g.generation_id <> s.active_generation_id AND g.fingerprint = a.fingerprint) WHERE r = 1)"""


@over_model("j7_rollback_target", f", {ROLLBACK_SQL} SELECT * FROM targets")
def j7(spark, d):
    return L.rollback_targets(M.sources(spark, d), M.generations(spark, d))


@over_model("j8_reclaimable", f", {ROLLBACK_SQL} SELECT generation_id FROM gens WHERE state <> 'building' AND created_at < {AS_OF} - INTERVAL 24 HOUR AND generation_id NOT IN (SELECT active_generation_id FROM srcs WHERE active_generation_id IS NOT NULL UNION ALL SELECT target FROM targets)")
def j8(spark, d):
    return L.reclaimable(M.sources(spark, d), M.generations(spark, d), F.expr(AS_OF))


@over_model("j9_restore_status", "SELECT source_id, CASE WHEN EXISTS (SELECT 1 FROM gens g WHERE g.source_id = s.source_id AND state = 'building') THEN status WHEN active_generation_id IS NOT NULL THEN 'ready' ELSE 'error' END AS status FROM srcs s")
def j9(spark, d):
    return L.restore_status(M.sources(spark, d), M.generations(spark, d))


@query("j10_semi_join", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j10(spark, d):
    return table(spark, d, "events").join(table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("user_id")), "user_id", "left_semi").select("event_id", "user_id")


@query("j13_orphans", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def j13(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@over_model("g1_claim", "SELECT source_id FROM srcs WHERE source_id NOT IN (SELECT source_id FROM gens WHERE state = 'building')")
def g1(spark, d):
    return L.claim(M.sources(spark, d), M.generations(spark, d))


@over_model("g3_publish_check", """
, st AS (SELECT generation_id, count(*) AS stored FROM chunks WHERE generation_id LIKE '%-2' AND source_id % 13 <> 0 GROUP BY generation_id)
SELECT generation_id, coalesce(stored, 0) AS stored, state = 'building' AND coalesce(stored, 0) > 0 AND stored = expected_chunks AS publish_ok,
 CASE WHEN state <> 'building' THEN 'not_building' WHEN coalesce(stored, 0) = 0 THEN 'no_chunks' WHEN stored <> expected_chunks THEN 'count_mismatch' ELSE 'ok' END AS reason FROM gens LEFT JOIN st USING (generation_id)""")
def g3(spark, d):
    return L.publish_check(M.generations(spark, d), M.chunks(spark, d).where("generation_id LIKE '%-2' AND source_id % 13 <> 0"))


@over_model("g8_fail_stale", f"SELECT generation_id, CASE WHEN state = 'building' AND created_at < {AS_OF} - INTERVAL 1200 SECOND THEN 'failed' ELSE state END AS state FROM gens")
def g8(spark, d):
    return L.fail_stale(M.generations(spark, d), F.expr(AS_OF)).select("generation_id", "state")


@over_model("g9_active_leases", "SELECT generation_id FROM gens WHERE (source_id, generation_id) IN (SELECT source_id, active_generation_id FROM srcs)")
def g9(spark, d):
    pairs = M.sources(spark, d).select("source_id", F.col("active_generation_id").alias("generation_id"))
    return M.generations(spark, d).join(pairs, ["source_id", "generation_id"], "left_semi").select("generation_id")


@over_model("a5_duplicate_positions", "SELECT source_id, chunk_index, count(*) AS n FROM chunks GROUP BY source_id, chunk_index HAVING count(*) > 1 ORDER BY n DESC, source_id, chunk_index LIMIT 5")
def a5(spark, d):
    return M.chunks(spark, d).groupBy("source_id", "chunk_index").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "source_id", "chunk_index").limit(5)


@over_model("a7_stored_recount", "SELECT generation_id, expected_chunks, count(chunk_index) AS stored FROM gens LEFT JOIN chunks USING (generation_id) GROUP BY generation_id, expected_chunks")
def a7(spark, d):
    counts = M.chunks(spark, d).groupBy("generation_id").agg(F.count("*").alias("stored"))
    return M.generations(spark, d).join(counts, "generation_id", "left").select("generation_id", "expected_chunks", F.coalesce("stored", F.lit(0)).alias("stored"))


@over_model("a11_unique_parents", "SELECT source_id, count(DISTINCT parent) AS parents, count(*) AS chunks FROM chunks WHERE generation_id LIKE '%-2' GROUP BY source_id")
def a11(spark, d):
    return M.chunks(spark, d).where("generation_id LIKE '%-2'").groupBy("source_id").agg(F.countDistinct("parent").alias("parents"), F.count("*").alias("chunks"))


@over_model("p15_status_counts", "SELECT status, kind, count(*) AS n FROM srcs GROUP BY status, kind")
def p15(spark, d):
    return M.sources(spark, d).groupBy("status", "kind").agg(F.count("*").alias("n"))


@over_model("s15_chunk_upsert", "SELECT source_id, chunk_index, generation_id, sha256(content) AS h FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chunk_index ORDER BY generation_id DESC) AS r FROM chunks) WHERE r = 1")
def s15(spark, d):
    c = M.chunks(spark, d)
    merged = L.upsert(c.where("generation_id LIKE '%-1'"), c.where("generation_id LIKE '%-2'"), ["source_id", "chunk_index"], "generation_id")
    return merged.select("source_id", "chunk_index", "generation_id", F.sha2("content", 256).alias("h"))


@query("s16_insert_if_absent", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def s16(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(done, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("w3_latest_per_group", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def w3(spark, d):
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, d, "conversations").withColumn("r", F.row_number().over(newest)).where("r = 1").select("conv_id", "turn", "role")


@query("w5_history_fit", "SELECT conv_id, turn FROM (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 600")
def w5(spark, d):
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").withColumn("used", F.sum(F.octet_length("text") + 1).over(newest)).where("used <= 600").select("conv_id", "turn")


@query("w6_last_n_history", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def w6(spark, d):
    newest, oldest = Window.partitionBy("conv_id").orderBy(F.desc("turn")), Window.partitionBy("conv_id").orderBy("turn")
    last = table(spark, d, "conversations").withColumn("r", F.row_number().over(newest)).where("r <= 3")
    return last.select("conv_id", "turn", F.row_number().over(oldest).cast("bigint").alias("pos"))


@query("k8_pagination", """
SELECT conv_id, turn, CAST(n AS BIGINT) AS total, n > 4 AS has_more, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS pos
FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r BETWEEN 3 AND 4""")
def k8(spark, d):
    w = Window.partitionBy("conv_id")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.count("*").over(w).alias("total"), F.row_number().over(w.orderBy(F.desc("turn"))).alias("r"))
    return c.where("r BETWEEN 3 AND 4").select("conv_id", "turn", "total", (F.col("total") > 4).alias("has_more"), F.row_number().over(w.orderBy("turn")).cast("bigint").alias("pos"))


@query("w10_sessions", """
SELECT user_id, session, count(*) AS n, min(ts) AS first_ts FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
 FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1800 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, session""")
def w10(spark, d):
    from docloom.streaming.events import sessions

    return sessions(table(spark, d, "events")).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("w7_carry_forward_heading", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents)
SELECT doc_id, pos, last_value(nullif(trim(regexp_extract(CASE WHEN pos % 4 = 0 THEN '## ' || line ELSE line END, '^\s*#{1,4} (.*)$', 1)), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS heading FROM l""")
def w7(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    mark = X.heading(F.when(F.col("pos") % 4 == 0, F.concat(F.lit("## "), F.col("line"))).otherwise(F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.last(mark, ignorenulls=True).over(w).alias("heading"))


@query("a15_nearest_rank_percentile", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def a15(spark, d):
    ranked = "percentile_disc({}) WITHIN GROUP (ORDER BY value)"
    return table(spark, d, "events").groupBy("event_type").agg(F.expr(ranked.format(0.5)).alias("p50"), F.expr(ranked.format(0.95)).alias("p95"))
