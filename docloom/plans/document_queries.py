"""Sources, chunking, citations and index queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import chunking as CH, citations as CI
from docloom.operators import ann
from docloom.plans.registry import query, table
from docloom.plans.retrieval_queries import vector_questions, vectors
from docloom.sources import extract as S


@query("s1_source_types", "SELECT event_id, CASE (event_id % 9) WHEN 0 THEN 'pdf' WHEN 1 THEN 'markdown' WHEN 2 THEN 'text' WHEN 3 THEN 'web' WHEN 4 THEN 'youtube' WHEN 5 THEN 'docx' WHEN 6 THEN 'epub' WHEN 7 THEN 'markdown' END AS kind FROM events")
def s1(spark, d):
    names = F.array(*map(F.lit, ("PDF", "md", " txt ", "Url", "yt", "docx", "epub", "Markdown", "spreadsheet")))
    return table(spark, d, "events").select("event_id", S.source_type(names[(F.col("event_id") % 9).cast("int")]).alias("kind"))


@query("s9_html_body_text")
def s9(spark, d):
    return S.html_column(table(spark, d, "pages"))


@query("s12_transcript_sections")
def s12(spark, d):
    talk = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 25).alias("start"), "text")
    return S.transcript_sections(talk, "conv_id")


@query("i3_parent_child_chunks")
def i3(spark, d):
    return CH.chunk_documents(table(spark, d, "documents"))


@query("i8_span_violations", r"SELECT doc_id, 0 AS chunk_index FROM documents WHERE doc_id % 50 = 7 AND regexp_matches(text, '\S')")
def i8(spark, d):
    """Chunks whose span does not give back their content: none but the first ones of a fiftieth of the documents, whose spans are moved by a byte here."""
    docs = table(spark, d, "documents")
    moved = ((F.col("doc_id") % 50 == 7) & (F.col("chunk_index") == 0)).cast("int")
    chunks = CH.chunk_documents(docs).withColumns({"start": F.col("start") + moved, "end": F.col("end") + moved})
    return CH.span_violations(docs, chunks)


@query("i4_flat_index", r"""
SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS chunk_index, unnest(list_transform(string_split(text, chr(10)), lambda l: sha256(l))) AS content_hash FROM documents WHERE text IS NOT NULL""")
def i4(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    return lines.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.sha2("line", 256).alias("content_hash"))


@query("i6_fingerprints", "SELECT doc_id, 'chunk:v1:characters:' || (doc_id % 4) || ':' || CASE WHEN doc_id % 2 = 0 THEN 1024 ELSE 2048 END || '/256+25' AS fingerprint FROM documents")
def i6(spark, d):
    size = F.when(F.col("doc_id") % 2 == 0, 1024).otherwise(2048)
    return table(spark, d, "documents").select("doc_id", F.format_string("chunk:v1:characters:%d:%d/%d+%d", F.col("doc_id") % 4, size, F.lit(CH.CHILD), F.lit(CH.OVERLAP)).alias("fingerprint"))


ANSWER_SQL = "SELECT conv_id, turn, text || ' [' || turn || '] `[1]` then [3][2] and [99] ' || '```' || chr(10) || '[4]' AS a FROM conversations"


@query("c19_citation_markers", rf"""
SELECT conv_id, turn, array_to_string(list_filter([CAST(x AS INT) FOR x IN m], lambda n: n BETWEEN 1 AND 5), ',') AS cited FROM (
 SELECT conv_id, turn, list_filter(f, lambda x, i: list_position(f, x) = i) AS m FROM (
  SELECT conv_id, turn, regexp_extract_all(regexp_replace(a, '{CI.CODE}', '', 'g'), '\[(\d{{1,6}})\]', 1) AS f FROM ({ANSWER_SQL})))""")
def c19(spark, d):
    answer = F.concat(F.col("text"), F.lit(" ["), F.col("turn"), F.lit("] `[1]` then [3][2] and [99] ```\n[4]"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(CI.markers(answer, F.lit(5)), lambda n: n.cast("string")), ",").alias("cited"))


@query("r28_ann_benchmark", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, s FROM embeddings, (SELECT unnest([1, 10, 100]) AS s)),
p AS (SELECT q.s, q.vec_id AS question, row_number() OVER (PARTITION BY q.s, q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 6) DESC, v.vec_id) AS rank FROM v q JOIN v ON v.s = q.s AND v.vec_id % v.s = q.vec_id // 100 % q.s WHERE q.vec_id % 100 = 0)
SELECT 1.0::DOUBLE / s AS selectivity, count(DISTINCT question) AS questions, count(*) FILTER (rank <= 10) AS expected, count(*) FILTER (rank <= 10) AS returned, count(*) FILTER (rank <= 10) AS hits, 0::BIGINT AS misplaced, count(*) AS codes, true AS under_fifth FROM p GROUP BY s""")
def r28(spark, d):
    """Filters that all, a tenth and a hundredth of the vectors pass: full and exact results, from under a fifth of the vectors read."""
    found = ann.benchmark(vectors(spark, d), vector_questions(spark, d), k=10)
    return found.select("selectivity", "questions", "expected", "returned", "hits", "misplaced", "codes", (F.col("read") < 0.2 * F.col("vectors") * F.col("questions")).alias("under_fifth"))


@query("m12_hash_embedding")
def m12(spark, d):
    return ann.hash_embeddings(table(spark, d, "benchmark"), "item_id", "text")
