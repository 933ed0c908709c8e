"""JSON, array, codec and scalar operators, mapped from events, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from docloom.functions import values as V
from docloom.functions.text import word_tokens
from docloom.plans.registry import query, table


@query("s18_vector_codec", "SELECT vec_id, len(embedding) AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total, true AS same FROM embeddings")
def s18(spark, d):
    back = V.decode_vector(V.encode_vector(F.col("embedding")))
    total = F.aggregate(back, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.size(back).cast("bigint").alias("width"), F.round(total, 4).alias("total"), (back == F.col("embedding")).alias("same"))


@query("s5_ocr_merge", """
WITH p AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS page, unnest(string_split(text, chr(10))) AS native FROM documents),
o AS (SELECT doc_id, page + 1 AS page, 'ocr ' || page AS ocr FROM p WHERE page % 3 = 2)
SELECT doc_id, page, sha256(coalesce(ocr, native)) AS content FROM p FULL JOIN o USING (doc_id, page)""")
def s5(spark, d):
    native = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "native"))
    ocr = native.where("page % 3 = 2").select("doc_id", (F.col("page") + 1).alias("page"), F.concat(F.lit("ocr "), F.col("page")).alias("ocr"))
    return V.overlay(native, ocr, ["doc_id", "page"], "native", "ocr").select("doc_id", "page", F.sha2("content", 256).alias("content"))


@query("d9_batches", "SELECT vec_id, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS BIGINT) AS batch FROM embeddings")
def d9(spark, d):
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return table(spark, d, "embeddings").select("vec_id", F.floor((place - 1) / 16).alias("batch"))


@query("d7_metadata_json", """SELECT doc_id, '{"lang":"' || lang || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"source":"' || source || '"' ELSE '' END || '}' AS metadata FROM documents""")
def d7(spark, d):
    return table(spark, d, "documents").select("doc_id", F.to_json(F.struct("lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source"))).alias("metadata"))


@query("m11_backoff", "SELECT event_id, least(0.5::DOUBLE * pow(2, event_id % 9), 30) * (1 + floor(value) * 0.001) AS delay FROM events")
def m11(spark, d):
    return table(spark, d, "events").select("event_id", V.backoff(F.col("event_id") % 9, 0.5, 30.0, F.floor("value") * 0.001).alias("delay"))


@query("p6_finite_clamp", "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN -1.0::DOUBLE ELSE least(greatest(value / 50 - 0.5, 0), 1) END AS score FROM events")
def p6(spark, d):
    raw = F.when(F.col("event_id") % 17 == 0, F.lit(float("inf"))).otherwise(F.col("value") / 50 - 0.5)
    clamped = V.finite_clamp(raw)
    return table(spark, d, "events").select("event_id", F.when(F.abs(clamped) == float("inf"), -1.0).otherwise(clamped).alias("score"))


@query("p12_field_rules", "SELECT doc_id, strlen(source) BETWEEN 1 AND 255 AND length(text) <= 10000 AND lang IN ('en', 'fr', 'de', 'es') AS ok FROM documents")
def p12(spark, d):
    ok = V.within("source", 1, 255) & (F.length("text") <= 10_000) & F.col("lang").isin("en", "fr", "de", "es")
    return table(spark, d, "documents").select("doc_id", ok.alias("ok"))


@query("p13_public_hosts", "SELECT event_id, (a = 10 OR a = 127 OR a = 0 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR a >= 224) AS blocked FROM (SELECT event_id, [10, 127, 172, 192, 169, 100, 8, 224][CAST(event_id % 8 + 1 AS INT)] AS a, event_id * 7 % 256 AS b FROM events)")
def p13(spark, d):
    first = F.array(*map(F.lit, (10, 127, 172, 192, 169, 100, 8, 224)))[(F.col("event_id") % 8).cast("int")]
    host = F.format_string("%d.%d.1.1", first, F.col("event_id") * 7 % 256)
    return table(spark, d, "events").select("event_id", V.private_address(host).alias("blocked"))


@query("u4_ordered_reasons", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id")
def u4(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("u3_missing_categories", "SELECT user_id, e.event_type FROM (SELECT DISTINCT user_id FROM events) u JOIN (SELECT DISTINCT event_type FROM events) e ON true WHERE (user_id, e.event_type) NOT IN (SELECT user_id, event_type FROM events WHERE value > 50)")
def u3(spark, d):
    events = table(spark, d, "events")
    kinds = events.agg(F.collect_set("event_type").alias("kinds"))  # one row: the closed list of event types
    held = events.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("held"))
    return held.join(F.broadcast(kinds)).select("user_id", F.explode(F.array_except("kinds", "held")).alias("event_type"))


@query("a13_reason_histogram", "SELECT reason, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(lower(role || ' ' || CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END), ' '))) AS reason FROM conversations) GROUP BY reason")
def a13(spark, d):
    reasons = F.array("role", F.when(F.col("turn") % 2 == 0, "even").otherwise("odd"))
    return table(spark, d, "conversations").select(F.explode(F.array_distinct(reasons)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("r22_best_passage", r"""
WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 3)) AS w FROM benchmark),
t AS (SELECT item_id, unnest(w) AS term FROM q), p AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM conversations),
m AS (SELECT item_id, conv_id, turn, count(*) AS matched FROM t JOIN p USING (term) GROUP BY ALL)
SELECT item_id, conv_id, turn, matched FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY matched DESC, conv_id, turn) = 1""")
def r22(spark, d):
    terms = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.filter(word_tokens(F.col("text")), lambda w: F.length(w) >= 3))).alias("term"))
    passages = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term"))
    matched = passages.join(terms, "term").groupBy("item_id", "conv_id", "turn").agg(F.count("*").alias("matched"))
    best = Window.partitionBy("item_id").orderBy(F.desc("matched"), "conv_id", "turn")
    return matched.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


@query("k9_stable_sample", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) <= 6")
def k9(spark, d):
    order = Window.partitionBy("source").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", F.row_number().over(order).alias("r")).where("r <= 6").drop("r")


@query("c30_sse_frames", r"""SELECT conv_id, turn, len(list_filter(string_split('data: ' || replace(text, chr(10), chr(13) || chr(10) || 'data: ') || chr(10) || ': ping', chr(10)), lambda l: starts_with(l, 'data: '))) AS frames, sha256(text) AS payload FROM conversations""")
def c30(spark, d):
    wire = F.concat(F.lit("data: "), F.replace("text", F.lit("\n"), F.lit("\r\ndata: ")), F.lit("\n: ping"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(V.sse_data(wire)).cast("bigint").alias("frames"), F.sha2(F.array_join(V.sse_data(wire), "\n"), 256).alias("payload"))


@query("c11_byte_truncate", "SELECT doc_id, substr(text, 1, list_max(list_filter(range(0, 101), lambda k: strlen(substr(text, 1, k)) <= 100))) AS head FROM documents")
def c11(spark, d):
    return table(spark, d, "documents").select("doc_id", V.truncate_bytes(F.col("text"), 100).alias("head"))
