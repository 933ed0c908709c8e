"""Lifecycle writes, provenance, evidence and citations over the engine's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import citations as C
from docloom.operators import grounding as G, lifecycle as L, memory as MEM
from docloom.plans import model as M
from docloom.plans.registry import query, table
from docloom.plans.relational_queries import over_model


@over_model("g2_record_plan", "SELECT generation_id, CASE WHEN state = 'building' THEN expected_chunks * 2 ELSE expected_chunks END AS expected_chunks, CASE WHEN state = 'building' THEN 'lines:4' END AS chunking FROM gens")
def g2(spark, d):
    gens = M.generations(spark, d)
    plans = gens.where("state = 'building'").select("generation_id", (F.col("expected_chunks") * 2).alias("expected_chunks"), F.lit("lines:4").alias("chunking"))
    return L.record_plan(gens, plans).select("generation_id", "expected_chunks", "chunking")


@over_model("g4_pointer_move", """
, st AS (SELECT source_id, generation_id, count(*) AS n FROM chunks JOIN gens USING (source_id, generation_id) WHERE state = 'building' GROUP BY ALL)
SELECT s.source_id, coalesce(st.generation_id, active_generation_id) AS active_generation_id, n AS chunk_count, CASE WHEN n IS NULL THEN status ELSE 'ready' END AS status FROM srcs s LEFT JOIN st USING (source_id)""")
def g4(spark, d):
    building = M.generations(spark, d).where("state = 'building'").select("source_id", "generation_id")
    moves = M.chunks(spark, d).join(building, ["source_id", "generation_id"]).groupBy("source_id", "generation_id").agg(F.count("*").alias("chunks"))
    return L.move_pointers(M.sources(spark, d), moves).select("source_id", "active_generation_id", "chunk_count", "status")


@over_model("a8_backfill", """
, bare AS (SELECT source_id FROM srcs WHERE active_generation_id IS NULL OR source_id % 5 = 1)
SELECT 'legacy-' || source_id AS generation_id, source_id, 'published' AS state, 'legacy:v0' AS fingerprint, count(*) AS stored FROM chunks WHERE generation_id LIKE '%-1' AND source_id IN (FROM bare) GROUP BY source_id""")
def a8(spark, d):
    return L.backfill(*unpointed(spark, d), "legacy:v0")[0]


@over_model("j12_update_from", "SELECT source_id, CASE WHEN active_generation_id IS NULL OR source_id % 5 = 1 THEN 'legacy-' || source_id ELSE active_generation_id END AS active_generation_id FROM srcs")
def j12(spark, d):
    return L.backfill(*unpointed(spark, d), "legacy:v0")[1].select("source_id", "active_generation_id")


def unpointed(spark, d):
    """Sources of which a fifth and more have no pointer, and chunks without a generation."""
    pointer = F.when(F.col("source_id") % 5 != 1, F.col("active_generation_id"))
    chunks = M.chunks(spark, d).where("generation_id LIKE '%-1'").withColumn("generation_id", F.lit(None).cast("string"))
    return M.sources(spark, d).withColumn("active_generation_id", pointer), chunks


@over_model("g12_cascade_delete", """
, gone AS (SELECT source_id FROM srcs WHERE notebook_id IN (SELECT notebook_id FROM notebooks WHERE owner = 1))
SELECT 'sources' AS kept_in, count(*) AS n FROM srcs WHERE source_id NOT IN (FROM gone) UNION ALL SELECT 'generations', count(*) FROM gens WHERE source_id NOT IN (FROM gone) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE source_id NOT IN (FROM gone)""")
def g12(spark, d):
    sources = M.sources(spark, d)
    gone = sources.join(M.notebooks(spark, d).where("owner = 1"), "notebook_id", "left_semi")
    left = L.without({"sources": sources, "generations": M.generations(spark, d), "chunks": M.chunks(spark, d)}, gone, "source_id")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kept_in"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("a4_vector_problems", """
SELECT label, count(*) FILTER (v IS NULL) AS null_vectors, count(*) FILTER (len(v) <> 64) AS wrong_width, count(*) FILTER (vec_id % 7 = 3 AND v IS NOT NULL) AS non_finite, count(*) AS total
FROM (SELECT *, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN embedding[1:32] ELSE embedding END AS v FROM embeddings) GROUP BY label""")
def a4(spark, d):
    vector = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    broken = F.when(F.col("vec_id") % 7 == 3, F.transform(vector, lambda x, i: F.when(i == 1, F.lit(float("nan"))).otherwise(x).cast("float"))).otherwise(vector)
    rows = table(spark, d, "embeddings").withColumn("v", F.when(F.col("vec_id") % 11 != 0, broken))
    return L.vector_problems(rows, "label", "v", 64)


@query("s17_cache_insert", """
WITH cache AS (SELECT doc_id AS source_id, sha256(text) AS content_hash, 'm' || doc_id % 2 AS model, lang AS body FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text), doc_id % 2 ORDER BY doc_id) = 1),
 new AS (SELECT doc_id AS source_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE source END) AS content_hash, 'm' || doc_id % 4 AS model, source AS body FROM documents WHERE doc_id % 3 = 0),
 kept AS (SELECT c.* FROM cache c LEFT JOIN new n USING (source_id) WHERE n.model IS NULL OR (c.content_hash = n.content_hash AND c.model = n.model)),
 own AS (SELECT content_hash, model, max(source_id) AS owner, max_by(body, source_id) AS fresh FROM new GROUP BY ALL)
SELECT coalesce(owner, source_id) AS source_id, content_hash, model, coalesce(body, fresh) AS body FROM kept FULL JOIN own USING (content_hash, model)""")
def s17(spark, d):
    docs = table(spark, d, "documents")
    kind = lambda n: F.concat(F.lit("m"), F.col("doc_id") % n).alias("model")
    held = docs.select("doc_id", F.sha2("text", 256).alias("content_hash"), kind(2), "lang").groupBy("content_hash", "model").agg(F.min(F.struct("doc_id", "lang")).alias("first"))
    cache = held.select(F.col("first.doc_id").alias("source_id"), "content_hash", "model", F.col("first.lang").alias("body"))
    text = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("source"))
    new = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("source_id"), F.sha2(text, 256).alias("content_hash"), kind(4), F.col("source").alias("body"))
    return L.cache_insert(cache, new)


@over_model("i7_provenance", "SELECT generation_id, strlen(split_part(fingerprint, ':', 2)) > 0 AND expected_chunks = 7 AND state <> 'failed' AS ok FROM gens")
def i7(spark, d):
    prefix = F.when(F.col("state") == "failed", "legacy:").otherwise("lines:")
    ok = L.valid_provenance(F.split_part("fingerprint", F.lit(":"), F.lit(1)), F.split_part("fingerprint", F.lit(":"), F.lit(2)), F.col("expected_chunks"), [F.concat(prefix, F.col("fingerprint"))], 7)
    return M.generations(spark, d).select("generation_id", ok.alias("ok"))


@over_model("a1_scope_counts", "SELECT notebook_id, count(DISTINCT source_id) AS sources, count(*) AS chunks FROM chunks JOIN srcs USING (source_id) WHERE generation_id = active_generation_id GROUP BY notebook_id")
def a1(spark, d):
    sources = M.sources(spark, d).select("source_id", "notebook_id", "active_generation_id")
    held = M.chunks(spark, d).select("source_id", F.col("generation_id").alias("active_generation_id")).groupBy("source_id", "active_generation_id").agg(F.count("*").alias("n"))
    return sources.join(held, ["source_id", "active_generation_id"]).groupBy("notebook_id").agg(F.count("*").alias("sources"), F.sum("n").alias("chunks"))


@query("a10_mean_relevance", "SELECT event_type, CASE WHEN event_type IN ('purchase', 'error') THEN round(avg(value / 100), 6) END AS relevance FROM events GROUP BY event_type")
def a10(spark, d):
    mean = G.mean_relevance(F.col("event_type"), F.col("value") / 100, ("purchase", "error"))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(mean, 6).alias("relevance"))


@query("a17_time_range", """
SELECT doc_id, CASE WHEN n > 0 THEN 3.5::DOUBLE END AS first_start, CASE WHEN n > 0 THEN (n - 1) * 60 + 3.5::DOUBLE END AS last_start, CASE WHEN n > 0 THEN 'https://youtube.com/watch?v=abc&t=3' END AS citation_url
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE len(string_split(text, chr(10))) END AS n FROM documents)""")
def a17(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.lit("["), i, F.lit(":03.5] "), F.regexp_replace(line, r"[\[\]]", "")))
    text = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"[\[\]]", "")).otherwise(F.array_join(lines, "\n"))
    found = table(spark, d, "documents").select("doc_id", G.time_range(text).alias("r"))
    url = F.concat(F.lit("https://youtube.com/watch?v=abc&t="), F.col("r.first").cast("bigint"))
    return found.select("doc_id", F.col("r.first").alias("first_start"), F.col("r.last").alias("last_start"), url.alias("citation_url"))


LINES_SQL = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS page FROM documents"


@query("w8_page_lookup", f"""
WITH p AS (SELECT doc_id, page, CAST(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) - strlen(line) - 1 AS BIGINT) AS start FROM ({LINES_SQL})),
 o AS (SELECT doc_id, unnest(range(0, strlen(text), 100)) AS ask FROM documents)
SELECT o.doc_id, ask AS "offset", max(page) AS page FROM o JOIN p ON p.doc_id = o.doc_id AND p.start <= ask GROUP BY o.doc_id, ask""")
def w8(spark, d):
    from pyspark.sql import Window

    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    pages = lines.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("page"), (F.sum(F.octet_length("line") + 1).over(upto) - F.octet_length("line") - 1).alias("start"))
    size = F.octet_length("text").cast("bigint")
    asked = table(spark, d, "documents").where(size > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), size - 1, F.lit(100).cast("bigint"))).alias("offset"))
    return G.page_lookup(pages, asked, "doc_id")


@query("k7_reading_order", "SELECT conv_id, string_agg(turn || ':' || role, ' ' ORDER BY turn) AS reading FROM conversations GROUP BY conv_id")
def k7(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: F.concat(t["turn"], F.lit(":"), t["role"])), " ").alias("reading"))


@query("j11_preferred_sources", "SELECT DISTINCT user_id, 's' || event_id % 7 AS source_id FROM events WHERE event_type = 'purchase' AND event_id % 4 <> 0")
def j11(spark, d):
    source = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit('"s'), F.col("event_id") % 7, F.lit('"'))).otherwise("null")
    logs = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "purchase", 1).alias("feedback"), F.concat(F.lit('[{"source_id":'), source, F.lit(',"rank":1},{"rank":2}]')).alias("retrieved"))
    return MEM.preferred_sources(logs, "user_id", "retrieved")


@query("p16_memory_validity", r"""
SELECT conv_id, turn, sha256(x) AS h, ['fact', 'goal', 'other'][CAST(turn % 3 + 1 AS INT)] AS memory_type, CASE WHEN turn % 4 = 0 THEN 0.7::DOUBLE ELSE least(turn * 0.4, 1)::DOUBLE END AS salience,
 CASE WHEN turn % 2 = 0 THEN '{"source":"chat_extraction","extracted_from_topic":"' || role || '"}' ELSE '{"source":"chat_extraction"}' END AS metadata
FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM conversations) WHERE strlen(x) BETWEEN 1 AND 500 AND turn % 3 < 2""")
def p16(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("fact", "goal", "other"))), (F.col("turn") % 3 + 1).cast("int"))
    salience, context = F.when(F.col("turn") % 4 != 0, F.col("turn") * 0.4), F.when(F.col("turn") % 2 == 0, F.col("role"))
    memory = F.struct(F.col("text").alias("content"), kind.alias("memory_type"), salience.alias("salience"), context.alias("context"))
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(memory).alias("memories"))), F.lit("\n```"))
    replies = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("k"), raw.alias("raw"))
    return MEM.parsed_memories(replies, "k", "raw").select("k.*", F.sha2("content", 256).alias("h"), "memory_type", "salience", "metadata")


@query("c25_evidence", r"""
WITH e AS (SELECT conv_id, turn, '<source index="' || turn + 1 || '" source_id="' || conv_id || '" title="' || role || '"' || CASE WHEN turn % 2 = 1 THEN ' page="' || turn || '"' ELSE '' END || '>' || chr(10) || '<content>' || chr(10)
 || replace(replace(replace(replace(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || chr(10) || '</content>' || chr(10) || '</source>' || chr(10) || chr(10) AS entry FROM conversations)
SELECT conv_id, sha256('<untrusted_source_data>' || chr(10) || string_agg(entry, '' ORDER BY turn) || '</untrusted_source_data>') AS h FROM e GROUP BY conv_id""")
def c25(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("rank"), F.col("conv_id").alias("source_id"), F.col("role").alias("title"), F.when(F.col("turn") % 2 == 1, F.col("turn")).alias("page"), F.col("text").alias("body"))
    return G.evidence(rows, "conv_id").select("conv_id", F.sha2("evidence", 256).alias("h"))


@query("c20_preceding_claim", r"""
SELECT conv_id, turn, regexp_replace(regexp_replace(replace(regexp_extract(regexp_replace(regexp_replace(x, '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '([^\n!?.]*)$', 1), chr(1), '.'), '^\s*(?:[-*] )?\s*[:;]*\s*', ''), '\s+$', '') AS claim
FROM (SELECT *, regexp_replace(text, '[.!?\s]+$', '') AS x FROM conversations)""")
def c20(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", C.preceding_claim(F.regexp_replace("text", r"[.!?\s]+$", "")).alias("claim"))


@query("r23_abstention", "SELECT doc_id, doc_id % 4 = 0 OR contains(lower(text), 'no source was retrieved') AS abstained FROM documents")
def r23(spark, d):
    sentence = F.element_at(F.array(*map(F.lit, C.ABSTENTIONS)), (F.col("doc_id") % len(C.ABSTENTIONS) + 1).cast("int"))
    answer = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text"), F.lit(" "), F.upper(sentence))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", C.abstains(answer).alias("abstained"))


@query("d8_pointer_presence", """SELECT event_id, contains(props, '"k":') AS held, contains(props, '"absent":') AS absent FROM events""")
def d8(spark, d):
    present = lambda path: F.get_json_object("props", path).isNotNull()
    return table(spark, d, "events").select("event_id", present("$.k").alias("held"), present("$.absent").alias("absent"))


@query("d10_first_and_last_win", "SELECT user_id, event_type, min_by(value, (ts, event_id)) AS first_value, max_by(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id, event_type")
def d10(spark, d):
    order = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"))


@query("u5_summaries_first", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) AS BIGINT) AS pos, role FROM (SELECT DISTINCT conv_id, 0 AS part, 0 AS turn, 'summary' AS role FROM conversations UNION ALL SELECT conv_id, 1, turn, role FROM conversations)")
def u5(spark, d):
    from pyspark.sql import Window

    turns = table(spark, d, "conversations").select("conv_id", F.lit(1).alias("part"), "turn", "role")
    summaries = turns.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("turn"), F.lit("summary").alias("role")).distinct()
    order = Window.partitionBy("conv_id").orderBy("part", "turn")
    return summaries.unionByName(turns).select("conv_id", F.row_number().over(order).cast("bigint").alias("pos"), "role")
