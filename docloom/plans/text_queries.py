"""Text operators over documents, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import cleaning as CL, text as X
from docloom.operators.topics import shared_words
from docloom.plans.registry import query, table


def sql_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def over(name: str, key: str, column: str, **made: tuple) -> None:
    """Register ``name``: key and computed columns of one text column; made: (expression of a column, SQL over x)."""
    where = {"doc_id": "documents", "item_id": "benchmark", "conv_id": "conversations", "page_id": "pages"}[key]
    keys = [key, "turn"] if key == "conv_id" else [key]
    selected = ", ".join([*keys, *(f"{sql} AS {k}" for k, (_, sql) in made.items())])

    @query(name, f"SELECT {selected} FROM (SELECT *, {column} AS x FROM {where})")
    def run(spark, sf_dir):
        return table(spark, sf_dir, where).select(*keys, *(make(F.col(column)).alias(k) for k, (make, _) in made.items()))


STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
UNIX = r"regexp_replace(regexp_replace(x, '[\x00\f]', '', 'g'), '\r\n?', chr(10), 'g')"
SANITIZED = r"trim(regexp_replace(regexp_replace(x, '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))"
COMPACT = "array_to_string(list_filter(list_transform(string_split({}, chr(10)), lambda l: " + STRIP.format("l") + "), lambda l: l <> ''), chr(10))"
sha = lambda c: F.sha2(c, 256)

over("p3_query_sanitize", "item_id", "text", clean=(X.sanitize, SANITIZED))
over("c2_plain_clean", "doc_id", "text", h=(lambda c: sha(X.plain_clean(c)), f"sha256({COMPACT.format(UNIX)})"))
over(
    "c3_markdown_clean", "doc_id", "text",
    h=(lambda c: sha(X.markdown_clean(c)), rf"sha256(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({UNIX}, '[ \t]+(\n|$)', '\1', 'g'), '^\n+|\s+$', '', 'g'), '\n{{3,}}', chr(1), 'g'), '\n\n', chr(10), 'g'), chr(1), chr(10) || chr(10)))"),
)
over("c4_process_text", "doc_id", "text", h=(lambda c: sha(X.compact_lines(c)), f"sha256({COMPACT.format('x')})"))
over("c5_content_hash", "doc_id", "text", content_hash=(X.content_hash, "sha256(x)"))
over("c6_query_hash", "item_id", "text", query_hash=(X.query_hash, "left(sha256(x), 32)"))
over(
    "c7_stable_uuid", "item_id", "text",
    id=(X.stable_uuid, "left(sha256(x), 8) || '-' || substr(sha256(x), 9, 4) || '-4' || substr(sha256(x), 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(sha256(x), 17, 1)) - 1) % 4 + 1 AS INT), 1) || substr(sha256(x), 18, 3) || '-' || substr(sha256(x), 21, 12)"),
)
over("c8_lexical_tokens", "doc_id", "text", n=(lambda c: F.size(X.lexical_tokens(c)).cast("bigint"), f"CAST(len(list_filter(string_split(lower({SANITIZED}), ' '), lambda t: t <> '')) AS BIGINT)"), h=(lambda c: sha(F.array_join(X.lexical_tokens(c), " ")), f"sha256(array_to_string(list_filter(string_split(lower({SANITIZED}), ' '), lambda t: t <> ''), ' '))"))
over("c9_word_tokens", "doc_id", "text", n=(lambda c: F.size(X.word_tokens(c)).cast("bigint"), r"CAST(len(regexp_extract_all(lower(x), '[\p{L}\p{N}]+')) AS BIGINT)"), h=(lambda c: sha(F.array_join(X.word_tokens(c), " ")), r"sha256(array_to_string(regexp_extract_all(lower(x), '[\p{L}\p{N}]+'), ' '))"))
over("c10_truncate", "doc_id", "text", short=(lambda c: X.truncate(c, 200), "CASE WHEN length(x) > 200 THEN substr(x, 1, 197) || '...' ELSE x END"))
over("c12_truncate_at_word", "item_id", "text", short=(lambda c: X.truncate_at_word(c, 80), r"CASE WHEN length(x) <= 80 THEN x ELSE CASE WHEN regexp_extract(substr(x, 1, 80), '(?s)^(.*)[ ,]', 1) = '' THEN substr(x, 1, 80) ELSE regexp_extract(substr(x, 1, 80), '(?s)^(.*)[ ,]', 1) END || '…' END"))
over("c13_xml_escape", "page_id", "html", h=(lambda c: sha(X.xml_escape(c)), "sha256(replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;'))"))
over("c16_keywords", "item_id", "text", words=(lambda c: F.array_join(X.keywords(c), ","), r"array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(x), '\s+'), lambda t: regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')), lambda t: strlen(t) >= 5))), ',')"))
over("c23_strip_fences", "conv_id", "text", h=(lambda c: sha(X.strip_fences(F.concat(F.lit("```json\n"), c, F.lit("\n```")))), r"sha256(trim(regexp_replace(regexp_replace(trim('```json' || chr(10) || x || chr(10) || '```'), '^```(?:json)?', ''), '```$', '')))"))
over("p9_trivial_message", "conv_id", "text", trivial=(X.is_trivial, rf"strlen({STRIP.format('x')}) < 20 OR lower(trim(regexp_replace(x, '[^\p{{L}}\s]', '', 'g'))) IN ({sql_list(X.TRIVIAL)})"))
over("p10_needs_rewrite", "conv_id", "text", rewrite=(X.needs_rewrite, f"strlen(x) < 60 OR {sql_any('lower(x)', X.MARKERS)}"))
over("p11_content_limits", "doc_id", "text", ok=(lambda c: (F.octet_length(c) <= 20_000) & (F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) <= 2_000), r"strlen(x) <= 20000 AND len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) <= 2000"))
ASKED = r"replace({}, '.', '?' || chr(10))"  # the test texts have few question marks
over("p17_question_lines", "conv_id", "text", questions=(lambda c: F.array_join(X.question_lines(F.replace(c, F.lit("."), F.lit("?\n"))), "|"), f"array_to_string(list_slice(list_filter(list_transform(string_split({ASKED.format('x')}, chr(10)), lambda q: {STRIP.format('q')}), lambda q: q LIKE '%?' AND strlen(q) <= 200), 1, 3), '|')"), none=(lambda c: F.size(X.question_lines(F.replace(c, F.lit("?"), F.lit("")))).cast("bigint"), "CAST(0 AS BIGINT)"))
over("m13_token_estimate", "doc_id", "text", tokens=(X.token_estimate, "CAST(ceil(strlen(x) / 4.0::DOUBLE * 1.1::DOUBLE) AS BIGINT)"))
over("c28_locale", "doc_id", "lang", locale=(X.locale, "CASE WHEN x LIKE 'fr%' THEN 'fr' WHEN x LIKE 'de%' THEN 'de' WHEN x LIKE 'es%' THEN 'es' ELSE 'en' END"))
over("c29_error_category", "conv_id", "text", category=(X.error_category, "CASE " + " ".join(f"WHEN {sql_any('lower(x)', w)} THEN '{n}'" for n, w in X.ERRORS) + " ELSE 'unknown_error' END"))
over("s4_ocr_pages", "doc_id", "text", pages=(lambda c: F.size(F.filter(F.split(c, "\n"), lambda p: F.length(X.strip(p)) < 50)).cast("bigint"), f"CAST(len(list_filter(string_split(x, chr(10)), lambda p: length({STRIP.format('p')}) < 50)) AS BIGINT)"))
over("s6_ocr_codec", "doc_id", "text", back=(lambda c: F.size(F.split(F.array_join(F.transform(F.split(c, "\n"), lambda p: F.replace(p, F.lit("\f"), F.lit(""))), "\f"), "\f")).cast("bigint"), "CAST(len(string_split(array_to_string(list_transform(string_split(x, chr(10)), lambda p: replace(p, chr(12), '')), chr(12)), chr(12))) AS BIGINT)"))
@query("p14_magic_bytes", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' END AS kind FROM pages")
def p14_magic_bytes(spark, sf_dir):
    """The kind of files that begin like a PDF, like an archive, like one with a byte missing, and like a page."""
    first = F.element_at(F.array(*map(F.lit, (b"%PDF-1.7 ", b"PK\x03\x04", b"PK\x03", b""))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", X.file_kind(F.concat(first, F.encode(F.coalesce("html", F.lit("")), "UTF-8"))).alias("kind"))


@query("c27_citation_url", """
SELECT page_id, CASE WHEN page_id % 5 <> 4 THEN 'https://youtube.com/watch?v=' || left(sha256(url), 11) || '&t=' || CAST(page_id * 7 // 2 AS VARCHAR) END AS link FROM pages""")
def c27_citation_url(spark, sf_dir):
    """Links to a place in a video, for five ways of writing its address; the fifth is no video."""
    code = F.substring(F.sha2("url", 256), 1, 11)
    ways = [("https://www.youtube.com/watch?v=", "&t=3"), ("https://youtu.be/", "?si=x"), ("https://m.youtube.com/shorts/", ""), ("http://youtube.com/embed/", "#a"), ("https://example.com/watch?v=", "")]
    made = F.element_at(F.array(*[F.concat(F.lit(x), code, F.lit(y)) for x, y in ways]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", X.citation_url(X.video_id(made), F.col("page_id") * 3.5).alias("link"))


@query("c15_headings", r"""
SELECT doc_id, pos, nullif(trim(regexp_extract(line, '^\s*#{1,4} (.*)$', 1)), '') AS heading
FROM (SELECT doc_id, pos, CASE WHEN pos % 5 = 0 THEN repeat('#', CAST(pos % 6 AS INT) + 1) || ' ' || line ELSE line END AS line
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents))""")
def c15_headings(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))
    marked = F.when(F.col("pos") % 5 == 0, F.concat(F.expr("repeat('#', CAST(pos % 6 AS INT) + 1)"), F.lit(" "), F.col("line"))).otherwise(F.col("line"))
    return lines.select("doc_id", "pos", X.heading(marked).alias("heading"))


@query("c17_topic_overlap", r"""
WITH k AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), lambda t: strlen(t) >= 9) AS words FROM benchmark)
SELECT doc_id, count(DISTINCT item_id) FILTER (len(list_filter(words, lambda w: contains(lower(text), w))) > 0) AS items FROM documents, k GROUP BY doc_id""")
def c17_topic_overlap(spark, sf_dir):
    """With how many benchmark items each document shares a topic: a word of nine bytes or more that its text holds.

    The items are the questions asked.
    """
    long_words = lambda text: F.filter(F.array_distinct(X.word_tokens(text)), lambda t: F.octet_length(t) >= 9)
    items = table(spark, sf_dir, "benchmark").select("item_id", long_words(F.col("text")).alias("words"))
    docs = table(spark, sf_dir, "documents").select("doc_id", long_words(F.col("text")).alias("words"))
    return shared_words(docs, items)


@query("c24_contextualized", "SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || chr(10) || text ELSE text END) AS h FROM documents")
def c24_contextualized(spark, sf_dir):
    prefix = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", sha(X.contextualize(prefix, F.col("text"))).alias("h"))


@query("c26_minutes_seconds", "SELECT event_id, printf('%02d:%02d', CAST(floor(floor(value) / 60) AS BIGINT), CAST(floor(value) AS BIGINT) % 60) AS stamp FROM events WHERE value >= 0")
def c26_minutes_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value >= 0").select("event_id", X.minutes_seconds(F.col("value")).alias("stamp"))


@query("w9_consecutive_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (trim(line) = '' OR before IS NULL OR before <> trim(line)) AS n_kept FROM k GROUP BY doc_id""")
def w9_consecutive_lines(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    kept = F.expr("size(filter(l, (x, i) -> x = '' OR i = 0 OR l[i - 1] <> x))")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", lines.alias("l")).select("doc_id", F.size("l").cast("bigint").alias("n_lines"), kept.cast("bigint").alias("n_kept"))


def cleaning_sql(text: str) -> str:
    """The steps of page cleaning as nested calls."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    for kind, what, by in CL.steps():
        text = f"replace({text}, {quoted(what)}, {quoted(by)})" if kind == "text" else f"regexp_replace({text}, {quoted(what)}, '{chr(92) + by if by else ''}', 'g')"
    return text


PAGE_SQL = "'[Home](/) > docs' || chr(10) || '![logo](a.png)' || chr(10) || text || chr(10) || '[More](/more)' || chr(10) || '## ' || chr(10) || 'See [this page](/x) at 12:30.' || chr(10) || 'Same' || chr(10) || ' Same'"


@query("c1_scraped_cleaning", rf"""
WITH s AS (SELECT doc_id, string_split(replace({cleaning_sql(PAGE_SQL)}, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM s),
k AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare FROM u),
d AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM (SELECT * FROM k QUALIFY bare = '' OR i = 1 OR lag(bare) OVER (PARTITION BY doc_id ORDER BY i) <> bare) GROUP BY doc_id)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)^\s+$', '', 'g'), '^\s+|\s+$', '', 'g')) AS h FROM d""")
def c1_scraped_cleaning(spark, sf_dir):
    page = F.concat(F.lit("[Home](/) > docs\n![logo](a.png)\n"), F.col("text"), F.lit("\n[More](/more)\n## \nSee [this page](/x) at 12:30.\nSame\n Same"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(CL.clean_scraped(page), 256).alias("h"))
