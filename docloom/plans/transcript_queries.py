"""Transcripts, caption tracks and character references, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.plans.registry import query, table
from docloom.sources import transcripts as S

_CODE = "CASE WHEN p LIKE '&#x%' THEN TRY_CAST('0x' || p[4:-2] AS BIGINT) WHEN p LIKE '&#%' THEN TRY_CAST(p[3:-2] AS BIGINT) END"
_NAMES = "CASE p WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '\"' WHEN '&apos;' THEN '''' ELSE p END"


@query("c14_entities", f"""WITH x AS (SELECT page_id, html, unnest(regexp_extract_all(html, '[^&]+|&(?:#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z_][A-Za-z0-9_.-]*);|&')) AS p, generate_subscripts(regexp_extract_all(html, '[^&]+|&(?:#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z_][A-Za-z0-9_.-]*);|&'), 1) AS i FROM pages),
c AS (SELECT page_id, i, p, CASE WHEN p LIKE '&_%' THEN {_CODE} END AS code FROM x),
r AS (SELECT page_id, i, p, CASE WHEN code BETWEEN 1 AND 1114111 AND code NOT BETWEEN 55296 AND 57343 THEN chr(CAST(code AS INT)) ELSE {_NAMES} END AS t FROM c)
SELECT page_id, sha256(string_agg(t, '' ORDER BY i)) AS resolved, CAST(length(string_agg(t, '' ORDER BY i)) AS BIGINT) AS n_chars, count(*) FILTER (p LIKE '&_%' AND t = p) AS unknown FROM r GROUP BY page_id""")
def c14(spark, d):
    """References of whole pages resolved, and how many are of no entity of XML's own."""
    text = S.resolve_entities(F.col("html"))
    names = F.filter(F.regexp_extract_all("html", F.lit(r"&[A-Za-z_][A-Za-z0-9_.-]*;"), 0), lambda p: ~p.isin(*(f"&{e};" for e in S.ENTITIES)))
    return table(spark, d, "pages").where("html <> ''").select("page_id", F.sha2(text, 256).alias("resolved"), F.length(text).cast("bigint").alias("n_chars"), F.size(names).cast("bigint").alias("unknown"))


_TRACKS = "SELECT conv_id, turn, ['en', 'fr', 'de', 'es'][(conv_id * 3 + turn) % 4 + 1] AS language, CASE WHEN (conv_id + turn) % 3 <> 0 THEN 'asr' END AS kind, ['fr', 'es', 'pt'][conv_id % 3 + 1] AS wanted FROM conversations"


@query("s11_caption_track", f"SELECT conv_id, wanted, turn, language, kind IS NOT NULL AS generated FROM ({_TRACKS}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN language = wanted THEN 0 WHEN language = 'en' THEN 2 ELSE 4 END + CASE WHEN kind = 'asr' THEN 1 ELSE 0 END, turn) = 1")
def s11_track(spark, d):
    """Each conversation's turns as caption tracks, one of which is chosen for the language that is asked for."""
    at = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    c, t = F.col("conv_id"), F.col("turn")
    track = F.struct(t.alias("turn"), at(("en", "fr", "de", "es"), (c * 3 + t) % 4).alias("language"), F.when((c + t) % 3 != 0, "asr").alias("kind"))
    tracks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(track)).alias("tracks"))
    wanted = at(("fr", "es", "pt"), c % 3)
    chosen = tracks.withColumn("wanted", wanted).withColumn("t", S.caption_track(F.col("tracks"), [F.col("wanted"), F.lit("en")]))
    return chosen.select("conv_id", "wanted", "t.turn", "t.language", F.col("t.kind").isNotNull().alias("generated"))


@query("s11_transcript_snippets", r"""WITH s AS (SELECT conv_id, turn, turn * 7.25::DOUBLE AS start, CASE WHEN turn % 4 = 3 THEN 0 ELSE 3.5::DOUBLE END AS duration, regexp_replace(text, '^[[:space:]]+|[[:space:]]+$', '', 'g') AS text FROM conversations)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS position, start, duration, text FROM s WHERE text <> ''""")
def s11_snippets(spark, d):
    """Every conversation written as a transcript, half as XML and half as JSON, and read back."""
    turn = F.col("turn")
    long = turn % 4 != 3
    element = F.concat(F.lit('<text start="'), (turn * 7.25).cast("string"), F.when(long, '" dur="3.5">').otherwise('">'), X.xml_escape(F.col("text")), F.lit("</text>"))
    event = F.struct((turn * 7250).cast("bigint").alias("tStartMs"), F.when(long, 3500).cast("bigint").alias("dDurationMs"), F.array(F.struct(F.substring("text", 1, 9).alias("utf8")), F.struct(F.substring("text", 10, 1 << 30).alias("utf8"))).alias("segs"))
    rows = table(spark, d, "conversations").select("conv_id", F.struct("turn", element.alias("element"), event.alias("event")).alias("x"))
    told = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    xml = F.concat(F.lit("<?xml version=\"1.0\"?><transcript>"), F.array_join(F.transform("x", lambda r: r["element"]), "\n"), F.lit("</transcript>"))
    json = F.to_json(F.struct(F.transform("x", lambda r: r["event"]).alias("events")))
    return S.transcript_snippets(told.select("conv_id", F.when(F.col("conv_id") % 2 == 0, xml).otherwise(json).alias("content")), "conv_id", "content")
