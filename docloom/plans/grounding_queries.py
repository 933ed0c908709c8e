"""Numbers, code spans, claim support, citation checks and grounding metrics, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docloom.functions import citations as C, claims as CL
from docloom.operators import grounding as G, grounding_eval as E
from docloom.plans.registry import query, table


def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_SEP = "[" + CL.SEPARATORS.replace("'", "''") + "]"
_NUMBER_WORDS = [*CL.LINKS, *CL.ATOMS, *CL.FACTORS, *CL.SCALES]
_case = lambda table, x: f"CASE {x} {' '.join(f'WHEN {w!r} THEN {n}' for w, n in table.items())} END"
TOKENS = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def number_sql(src: str, p: str = "") -> str:
    """Common table expressions that end in ``{p}vals`` (k, v): the numbers of the texts t of ``src`` (k, t), word by word in a recursion."""
    return rf"""
{p}runs AS (SELECT k, unnest(regexp_extract_all(regexp_replace(t, '([0-9])[-+]', '\1~', 'g'), '[-+]?[.,]?[0-9]+(?:{_SEP}[0-9]+)*')) AS r FROM {src}),
{p}cut AS (SELECT *, starts_with(r, '-') AS neg, regexp_replace(regexp_replace(r, '^[-+]', ''), '^([.,])', '0\1') AS u FROM {p}runs),
{p}grp AS (SELECT *, regexp_split_to_array(u, '{_SEP}') AS g, regexp_extract_all(u, '{_SEP}') AS m FROM {p}cut),
{p}kind AS (SELECT *, len(g) AS n, CASE
   WHEN len(g) = 1 THEN 'int'
   WHEN m[-1] IN ('.', ',') AND (length(g[-1]) <> 3 OR length(g[1]) > 3 OR len(list_filter(m[1:len(m) - 1], lambda x: x <> m[-1])) > 0)
     AND (len(g) = 2 OR (length(g[1]) <= 3 AND len(list_filter(g[2:len(g) - 1], lambda x: length(x) <> 3)) = 0)) THEN 'dec'
   WHEN (len(g) > 2 OR m[1] NOT IN ('.', ',')) AND length(g[1]) <= 3 AND len(list_filter(g[2:], lambda x: length(x) <> 3)) = 0 THEN 'int'
   WHEN len(g) = 2 AND m[1] IN ('.', ',') THEN 'dec' ELSE 'literal' END AS kind FROM {p}grp),
{p}lits AS (SELECT k, CASE kind WHEN 'literal' THEN 'literal:' || regexp_extract(r, '^[-+]?') || u
   WHEN 'int' THEN CASE WHEN ltrim(array_to_string(g, ''), '0') = '' THEN '0' ELSE CASE WHEN neg THEN '-' ELSE '' END || ltrim(array_to_string(g, ''), '0') END
   ELSE CASE WHEN rtrim(g[-1], '0') = '' THEN CASE WHEN ltrim(array_to_string(g[1:n - 1], ''), '0') = '' THEN '0' ELSE CASE WHEN neg THEN '-' ELSE '' END || ltrim(array_to_string(g[1:n - 1], ''), '0') END
     ELSE CASE WHEN neg THEN '-' ELSE '' END || CASE WHEN ltrim(array_to_string(g[1:n - 1], ''), '0') = '' THEN '0' ELSE ltrim(array_to_string(g[1:n - 1], ''), '0') END || '.' || rtrim(g[-1], '0') END END AS v FROM {p}kind),
{p}w AS (SELECT k, list_append({TOKENS.format(t='t')}, '') AS w FROM {src}),
{p}toks AS (SELECT k, i, w[i] AS t, w[i + 1] AS x FROM {p}w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
{p}read AS (SELECT *, {_case(CL.ATOMS, 't')} AS atom, {_case(CL.FACTORS, 't')} AS factor, {_case(CL.SCALES, 't')} AS scale,
   t IN ({_sql_list(CL.LINKS)}) AND coalesce(regexp_matches(x, '[0-9]') OR x IN ({_sql_list(_NUMBER_WORDS)}), false) AS link FROM {p}toks),
{p}fold AS (SELECT k, 0::BIGINT AS i, 0::HUGEINT AS total, 0::HUGEINT AS cur, false AS saw, false AS skip, NULL::HUGEINT AS v FROM {p}w
  UNION ALL SELECT f.k, f.i + 1,
   CASE WHEN f.skip OR (r.link AND f.saw) OR r.factor IS NOT NULL OR r.atom IS NOT NULL THEN f.total WHEN r.scale IS NOT NULL THEN f.total + greatest(f.cur, 1) * r.scale ELSE 0 END,
   CASE WHEN f.skip OR (r.link AND f.saw) THEN f.cur WHEN r.t = 'quatre' AND r.x IN ('vingt', 'vingts') THEN f.cur + 80 WHEN r.factor IS NOT NULL THEN greatest(f.cur, 1) * r.factor WHEN r.atom IS NOT NULL THEN f.cur + r.atom ELSE 0 END,
   CASE WHEN f.skip OR (r.link AND f.saw) THEN f.saw ELSE coalesce(r.factor, r.scale, r.atom) IS NOT NULL END,
   NOT f.skip AND r.t = 'quatre' AND coalesce(r.x IN ('vingt', 'vingts'), false),
   CASE WHEN NOT f.skip AND NOT (r.link AND f.saw) AND f.saw AND coalesce(r.factor, r.scale, r.atom) IS NULL THEN f.total + f.cur END
  FROM {p}fold f JOIN {p}read r ON r.k = f.k AND r.i = f.i + 1),
{p}vals AS (SELECT k, v FROM {p}lits UNION ALL SELECT k, CAST(v AS VARCHAR) FROM {p}fold WHERE v IS NOT NULL)"""


def support_sql(src: str, p: str = "") -> str:
    """Common table expressions that end in ``{p}supported`` (k, ok) for the rows of ``src`` (k, claim, evidence)."""
    means = lambda t: f"list_filter({TOKENS.format(t=t)}, lambda w: strlen(w) >= 2 AND NOT regexp_matches(w, '[0-9]') AND NOT list_contains([{_sql_list([*CL.STOP_WORDS, *_NUMBER_WORDS])}], w))"
    return rf"""
{p}ct AS (SELECT k, claim AS t FROM {src}), {number_sql(f'{p}ct', f'{p}c')},
{p}et AS (SELECT k, evidence AS t FROM {src}), {number_sql(f'{p}et', f'{p}e')},
{p}bad AS (SELECT DISTINCT k FROM (SELECT k, v FROM {p}cvals EXCEPT SELECT k, v FROM {p}evals)),
{p}m AS (SELECT k, {means('claim')} AS w, {means('evidence')} AS b FROM {src}),
{p}supported AS (SELECT k, len(w) > 0 AND len(list_filter(w, lambda x: list_contains([{_sql_list(CL.POLARITY)}], x) AND NOT list_contains(b, x))) = 0
  AND 3 * len(list_filter(w, lambda x: list_contains(b, x))) >= 2 * len(w) AND k NOT IN (SELECT k FROM {p}bad) AS ok FROM {p}m)"""


#: Words that the texts of parts are made of, some of them numbers.
WORDS = ["two", "hundred", "and", "thirty", "quatre", "vingt", "dozen", "thousand", "et", "mille", "score", "seven", "pages", "million", "zéro", "the"]
_PART_SQL = f"""
SELECT p_partkey AS k, p_name || ' ' || CASE p_partkey % 8 WHEN 0 THEN whole || '.' || cents WHEN 1 THEN high || ',' || low || '.' || cents WHEN 2 THEN high || ' ' || low WHEN 3 THEN '-' || whole || ',' || cents
  WHEN 4 THEN high || '.' || low WHEN 5 THEN '.' || cents WHEN 6 THEN whole || '-' || p_size ELSE p_size || ',' || high || ',' || cents END || ' ' || p_size || ' '
  || w[CAST(p_partkey % 16 AS INT) + 1] || ' ' || w[CAST(p_partkey // 16 % 16 AS INT) + 1] || ' ' || w[CAST(p_partkey * 7 // 3 % 16 AS INT) + 1] || ' ' || w[CAST(p_partkey * 5 // 11 % 16 AS INT) + 1] AS t
FROM (SELECT *, [{_sql_list(WORDS)}] AS w, CAST(c // 100 AS VARCHAR) AS whole, lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS cents, CAST(c // 100000 AS VARCHAR) AS high, lpad(CAST(c // 100 % 1000 AS VARCHAR), 3, '0') AS low
      FROM (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part))"""


@query("c22_number_values", f"WITH RECURSIVE src AS ({_PART_SQL}), {number_sql('src')} SELECT k AS p_partkey, coalesce(string_agg(v, '|' ORDER BY v), '') AS numbers FROM (SELECT DISTINCT k, v FROM (SELECT k, v FROM vals UNION ALL SELECT k, NULL FROM src)) GROUP BY k")
def c22(spark, d):
    """The numbers of a text about every part, with its price and size in eight ways of writing and four more words."""
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    div = lambda x, n: F.floor(x / n).cast("bigint").cast("string")
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size", cents.alias("c"))
    whole, low, high, frac = div(F.col("c"), 100), F.lpad((F.floor(F.col("c") / 100) % 1000).cast("string"), 3, "0"), div(F.col("c"), 100_000), F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    k, comma = F.col("p_partkey"), F.lit(",")
    ways = [F.concat(whole, F.lit("."), frac), F.concat(high, comma, low, F.lit("."), frac), F.concat(high, F.lit(" "), low), F.concat(F.lit("-"), whole, comma, frac), F.concat(high, F.lit("."), low), F.concat(F.lit("."), frac), F.concat(whole, F.lit("-"), "p_size"), F.concat("p_size", comma, high, comma, frac)]
    words = F.array(*map(F.lit, WORDS))
    word = lambda i: F.get(words, (i % 16).cast("int"))
    text = F.concat_ws(" ", "p_name", F.get(F.array(*ways), (k % 8).cast("int")), "p_size", word(k), word(F.floor(k / 16)), word(F.floor(k * 7 / 3)), word(F.floor(k * 5 / 11)))
    return part.select("p_partkey", F.array_join(F.array_sort(F.array_distinct(CL.number_values(text))), "|").alias("numbers"))


_CODE_SQL = CL.CODE.replace("'", "''")
_TICKED = "replace(replace(text, 'an', '```'), 'st', '`')"


@query("c18_code_ranges", rf"""
SELECT conv_id, turn, coalesce(string_agg(start || '-' || start + strlen(code[i]), ',' ORDER BY i), '') AS ranges FROM (
  SELECT conv_id, turn, i, code, CAST(coalesce(list_sum(list_transform(out[1:i], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(code[1:i - 1], lambda x: strlen(x))), 0) AS BIGINT) AS start
  FROM (SELECT conv_id, turn, regexp_split_to_array({_TICKED}, '{_CODE_SQL}') AS out, regexp_extract_all({_TICKED}, '{_CODE_SQL}') AS code FROM conversations)
  LEFT JOIN LATERAL (SELECT unnest(range(1, len(code) + 1)) AS i) ON true) GROUP BY conv_id, turn""")
def c18(spark, d):
    """Byte ranges of code in turns in which back-ticks and fences stand for two pairs of letters."""
    text = F.replace(F.replace("text", F.lit("an"), F.lit("```")), F.lit("st"), F.lit("`"))
    ranges = F.transform(CL.code_ranges(text), lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["stop"].cast("string")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(ranges, ",").alias("ranges"))


@query("c21_claim_support", f"""
WITH RECURSIVE src AS (SELECT conv_id || '-' || turn AS k, conv_id, turn, text AS claim, evidence FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS evidence FROM conversations) WHERE evidence IS NOT NULL
  UNION ALL SELECT conv_id || '-' || turn || '-own', conv_id, -1 - turn, regexp_extract(text, '^[^.]*'), text FROM conversations),
{support_sql('src', 'z_')}
SELECT conv_id, turn, ok AS supported FROM src JOIN z_supported USING (k)""")
def c21(spark, d):
    """Whether the next turn supports each turn, and (as turn -1, -2, ...) whether each turn supports its own first sentence."""
    turns = table(spark, d, "conversations")
    following = turns.withColumn("evidence", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("evidence IS NOT NULL")
    own = turns.select("conv_id", (-1 - F.col("turn")).alias("turn"), F.regexp_extract("text", "^[^.]*", 0).alias("text"), F.col("text").alias("evidence"))
    both = following.select("conv_id", "turn", "text", "evidence").unionByName(own)
    return both.select("conv_id", "turn", CL.supported(F.col("text"), F.col("evidence")).alias("supported"))


_CLAIM_SQL = r"regexp_replace(regexp_replace(replace(regexp_extract(regexp_replace(regexp_replace({p}, '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '([^\n!?.]*)$', 1), chr(1), '.'), '^\s*(?:[-*] )?\s*[:;]*\s*', ''), '\s+$', '')"


@query("r20_citation_verification", rf"""
WITH RECURSIVE a AS (SELECT conv_id, turn, conv_id || '-' || turn AS answer_id, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, regexp_replace(text, '\.', ' [1]. As said [2].', 'g') AS answer FROM conversations),
p AS (SELECT *, regexp_split_to_array(answer, '\[[0-9]+\]') AS s, regexp_extract_all(answer, '\[([0-9]+)\]', 1) AS n FROM a),
m AS (SELECT *, CAST(n[i] AS INT) AS no, array_to_string(list_transform(range(1, i + 1), lambda j: s[j] || CASE WHEN j < i THEN '[' || n[j] || ']' ELSE '' END), '') AS prefix FROM p, LATERAL (SELECT unnest(range(1, len(n) + 1)) AS i)),
c AS (SELECT answer_id || '-' || i AS k, answer_id, conv_id, turn, i, no, {_CLAIM_SQL.format(p='prefix')} AS claim, CASE no WHEN 1 THEN text ELSE before END AS evidence FROM m),
src AS (SELECT k, claim, evidence FROM c WHERE evidence IS NOT NULL), {support_sql('src', 'z_')},
v AS (SELECT c.*, CASE WHEN evidence IS NULL THEN 'missing_chunk' WHEN conv_id % 3 = 0 THEN 'stale' WHEN (turn - no + 1) % 5 = 4 THEN 'unowned' WHEN NOT ok THEN 'unsupported' END AS broken FROM c LEFT JOIN z_supported USING (k)),
w AS (SELECT answer_id, broken, row_number() OVER (PARTITION BY answer_id, no, broken IS NULL ORDER BY i) AS r FROM v),
t AS (SELECT answer_id, count(*) FILTER (broken IS NULL AND r = 1) AS cited, count(*) FILTER (broken IS NULL AND r > 1) AS again FROM w GROUP BY answer_id)
SELECT a.answer_id, coalesce(cited, 0) AS cited, len(regexp_extract_all(answer, '\[[0-9]+\]')) - coalesce(cited, 0) - coalesce(again, 0) AS rejected,
  {' OR '.join(f"contains(lower(answer), lower('{s.replace(chr(39), chr(39) * 2)}'))" for s in C.ABSTENTIONS)} AS abstained FROM a LEFT JOIN t USING (answer_id)""")
def r20(spark, d):
    """Answers are turns of which each sentence cites the turn's own text and the turn before; a third of the sources have moved on, a fifth of the chunks have another's span."""
    turns = table(spark, d, "conversations").withColumn("answer_id", F.concat_ws("-", "conv_id", "turn"))
    answers = turns.select("answer_id", F.regexp_replace("text", r"\.", " [1]. As said [2].").alias("answer"))

    def chunk(answer: F.Column, n: int) -> DataFrame:
        end = F.octet_length("text") + F.when(F.col("turn") % 5 == 4, 1).otherwise(0)
        owned = CL.owns_chunk(F.col("turn"), F.col("turn"), F.lit(0), end, F.lit(None).cast("int"), F.lit(None).cast("int"), F.col("text"))
        return turns.select(answer.alias("answer_id"), F.lit(n).cast("bigint").alias("n"), F.col("conv_id").alias("source_id"), F.lit("g1").alias("generation_id"), F.col("text").alias("content"), owned.alias("owned"))

    context = chunk(F.col("answer_id"), 1).unionByName(chunk(F.concat_ws("-", "conv_id", F.col("turn") + 1), 2))
    active = turns.select(F.col("conv_id").alias("source_id"), F.when(F.col("conv_id") % 3 == 0, "g2").otherwise("g1").alias("active_generation_id")).distinct()
    return G.citation_summary(answers, G.verify_citations(answers, context, active))


_FIRST = "regexp_extract(text, '^[^.\\n]*')"


@query("r21_native_citations", f"""
WITH RECURSIVE a AS (SELECT conv_id, turn, conv_id || '-' || turn AS answer_id, text, {_FIRST} AS first, CASE WHEN turn % 4 = 3 THEN '`' ELSE '' END AS tick, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
n AS (SELECT a.*, pos, CASE pos WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 7 END AS doc FROM a, (SELECT unnest(range(0, 4)) AS pos)),
src AS (SELECT answer_id AS k, {_CLAIM_SQL.format(p='tick || first')} AS claim, first AS evidence FROM a), {support_sql('src', 'z_')},
b AS (SELECT n.*, CASE WHEN doc = 7 OR (doc = 1 AND before IS NULL) THEN 'missing'
   WHEN trim(first) = '' OR NOT contains(CASE doc WHEN 0 THEN text ELSE before END, trim(first)) THEN 'not_quoted' WHEN NOT ok THEN 'unlinked' WHEN tick <> '' THEN 'in_code' WHEN conv_id % 3 = 1 THEN 'unowned' END AS broken
  FROM n JOIN z_supported ON k = answer_id),
r AS (SELECT *, row_number() OVER (PARTITION BY answer_id, doc, broken IS NULL ORDER BY pos) AS again FROM b),
num AS (SELECT answer_id, doc, row_number() OVER (PARTITION BY answer_id ORDER BY min(pos)) AS number FROM n WHERE doc = 0 OR (doc = 1 AND before IS NOT NULL) GROUP BY answer_id, doc)
SELECT r.answer_id, r.pos, r.doc AS document_index, CAST(number AS INT) AS number, coalesce(broken, CASE WHEN again > 1 THEN 'repeated' WHEN conv_id % 5 = 2 THEN 'stale' ELSE 'cited' END) AS reason FROM r LEFT JOIN num USING (answer_id, doc)""")
def r21(spark, d):
    """Each turn quotes its first sentence from the turn before, twice from itself, and from a document that is not there; some spans are shifted, some answers are code."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text", F.concat_ws("-", "conv_id", "turn").alias("answer_id"), F.regexp_extract("text", "^[^.\n]*", 0).alias("first"), F.when(F.col("turn") % 4 == 3, "`").otherwise("").alias("tick"))
    answers = turns.select("answer_id", F.concat("tick", "text").alias("answer"))
    cites = F.posexplode(F.array(F.lit(1), F.lit(0), F.lit(0), F.lit(7))).alias("pos", "document_index")
    native = turns.select("answer_id", F.col("first").alias("cited_text"), F.length(F.concat("tick", "first")).alias("marker_start"), cites).select(F.col("pos").cast("bigint").alias("pos"), "answer_id", "document_index", "cited_text", "marker_start")
    span = lambda shift: F.to_json(F.struct(F.col("turn").alias("position"), shift.alias("span_start"), (F.octet_length("text") + shift).alias("span_end")))

    def chunks(answer: F.Column, n: int) -> DataFrame:
        return turns.select(answer.alias("answer_id"), F.lit(n).alias("document_index"), F.col("conv_id").alias("source_id"), F.lit("g1").alias("generation_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"), span(F.lit(0)).alias("metadata"), span(F.when(F.col("conv_id") % 3 == 1, 1).otherwise(0)).alias("claimed"), F.lit(True).alias("owned"))

    context = chunks(F.col("answer_id"), 0).unionByName(chunks(F.concat_ws("-", "conv_id", F.col("turn") + 1), 1))
    documents = context.select("answer_id", "document_index", "source_id", "generation_id", "chunk_index", F.col("claimed").alias("metadata"))
    active = turns.select(F.col("conv_id").alias("source_id"), F.when(F.col("conv_id") % 5 == 2, "g2").otherwise("g1").alias("active_generation_id")).distinct()
    return G.resolve_native(answers, native, documents, context.drop("claimed"), active).withColumn("document_index", F.col("document_index").cast("bigint"))


def grounding_inputs(spark, d) -> dict[str, DataFrame]:
    """Every conversation as a question whose expected claims are the first sentences of its turns, and an answer that states most of them and cites turns for them."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text", F.regexp_extract("text", "^[^.\n]*", 0).alias("first"))
    convs = turns.select("conv_id").distinct()
    c = F.col("conv_id")
    queries = convs.select(F.col("conv_id").alias("query_id"), (c % 4).cast("string").alias("category"), F.when(c % 2 == 0, "train").otherwise("holdout").alias("split"), (c % 10 != 0).alias("answerable"), (c % 3).alias("notebook")).where("query_id % 13 <> 12")
    claims = turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("claim_id"), F.array(F.col("first"), F.left("first", F.lit(5))).alias("markers"), F.array(F.concat_ws("-", "conv_id", "turn"), F.lit("none")).alias("supported_by"))
    mark = F.concat(F.lit(" ["), F.col("turn") + 1, F.lit("]"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit(", ["), F.when(F.col("turn") % 4 == 1, 99).otherwise(1).cast("string"), F.lit("]"))).otherwise(""), F.lit(". "))
    stated = F.array_sort(F.collect_list(F.struct("turn", F.concat("first", mark).alias("part"))))
    answers = turns.where("turn % 5 <> 3").groupBy("conv_id").agg(F.array_join(stated["part"], "").alias("answer"))
    outcome = F.when(c % 11 == 5, "provider_error").when(c % 11 == 6, "abstained").otherwise("answered")
    cases = convs.join(answers, "conv_id", "left").select(
        F.col("conv_id").alias("query_id"), outcome.alias("outcome"), F.when(c % 11 == 7, C.ABSTENTIONS[3]).otherwise(F.coalesce("answer", F.lit(""))).alias("answer"),
        F.when(c % 5 == 0, 2).otherwise(0).alias("rejected"), F.when(c % 7 == 3, F.array(F.lit("g0"))).otherwise(F.array(F.lit("g0"), F.lit("g1"))).alias("generations"), (c % 6 != 1).alias("evidence_sufficient"),
    )
    marked = cases.select("query_id", F.posexplode(C.marker_places(F.col("answer"))).alias("pos", "m")).select("query_id", F.col("pos").cast("bigint").alias("pos"), "m.*")
    of = F.col("n") - 1
    texts = turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("at"), "text")
    quote = F.when(F.col("at") % 6 == 4, F.concat(F.lit("x"), F.left("text", F.lit(30)))).otherwise(F.concat(F.left("text", F.lit(30)), F.lit("...")))
    citations = marked.withColumn("at", of).join(texts, ["query_id", "at"], "left").select("query_id", "pos", "start", "stop", F.col("query_id").alias("source_id"), F.col("at").alias("chunk_index"), F.coalesce(quote, F.lit("")).alias("quote"))
    chunks = turns.select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("source_id"), F.col("turn").alias("chunk_index"), F.when(F.col("turn") % 7 == 6, -1).otherwise(c % 3).alias("chunk_notebook"), F.col("text").alias("content"))
    return {"queries": queries, "claims": claims, "cases": cases, "citations": citations, "chunks": chunks}


_GROUNDING_SQL = f"""
t AS (SELECT conv_id, turn, text, {_FIRST} AS first FROM conversations),
q AS (SELECT conv_id AS id, CAST(conv_id % 4 AS VARCHAR) AS category, CASE WHEN conv_id % 2 = 0 THEN 'train' ELSE 'holdout' END AS split, conv_id % 10 <> 0 AS answerable, conv_id % 13 <> 12 AS known,
    CASE WHEN conv_id % 11 = 5 THEN 'provider_error' WHEN conv_id % 11 IN (6, 7) THEN 'abstained' ELSE 'answered' END AS outcome, CASE WHEN conv_id % 5 = 0 AND conv_id % 11 NOT IN (5, 6) THEN 2 ELSE 0 END AS rejected, conv_id % 6 <> 1 AS enough FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (SELECT conv_id, turn, first || ' [' || turn + 1 || ']' || CASE WHEN turn % 2 = 1 THEN ', [' || CASE WHEN turn % 4 = 1 THEN 99 ELSE 1 END || ']' ELSE '' END || '. ' AS part FROM t WHERE turn % 5 <> 3),
ans AS (SELECT conv_id AS id, string_agg(part, '' ORDER BY turn) AS answer FROM parts GROUP BY conv_id),
live AS (SELECT q.id, answer FROM q JOIN ans USING (id) WHERE known AND outcome = 'answered' AND NOT contains(lower(answer), 'no source was retrieved')),
asserted AS (SELECT live.id, turn AS claim, first FROM live JOIN t ON t.conv_id = live.id WHERE contains(lower(answer), lower(first)) AND contains(lower(answer), lower(left(first, 5)))),
pieces AS (SELECT id, regexp_split_to_array(answer, '\\[[0-9]+\\]') AS s, regexp_extract_all(answer, '\\[([0-9]+)\\]', 1) AS n FROM live),
marks AS (SELECT id, i, s[i] AS local, CAST(n[i] AS BIGINT) - 1 AS place, i > 1 AND regexp_full_match(s[i], '[\\s!-/:-@\\[-`{{-~]*') AS continues FROM pieces, LATERAL (SELECT unnest(range(1, len(n) + 1)) AS i)),
direct AS (SELECT m.id, m.i, CASE WHEN count(*) = 1 THEN min(claim) END AS claim FROM marks m JOIN asserted a ON a.id = m.id AND contains(lower(local), lower(first)) AND contains(lower(local), lower(left(first, 5))) GROUP BY m.id, m.i),
runs AS (SELECT m.*, claim, sum(CASE WHEN continues THEN 0 ELSE 1 END) OVER (PARTITION BY m.id ORDER BY m.i) AS run FROM marks m LEFT JOIN direct d ON d.id = m.id AND d.i = m.i),
own AS (SELECT * EXCLUDE (claim), last_value(claim IGNORE NULLS) OVER (PARTITION BY id, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS claim FROM runs),
verdicts AS (SELECT own.*, CASE WHEN t.text IS NULL THEN 'unknown_chunk' WHEN own.id % 7 = 3 THEN 'stale_generation' WHEN place % 7 = 6 THEN 'cross_notebook'
    WHEN place % 6 = 4 AND NOT contains(t.text, trim(regexp_replace(trim('x' || left(t.text, 30)), '\\.+$', ''))) THEN 'span_mismatch' WHEN claim IS NULL OR claim <> place THEN 'unrelated_to_claim' ELSE 'correct' END AS verdict
  FROM own LEFT JOIN t ON t.conv_id = own.id AND t.turn = own.place),
v AS (SELECT id, count(*) AS cited, {', '.join(f"count(*) FILTER (verdict = '{x}') AS {x}" for x in E.VERDICTS[:-1])}, count(DISTINCT claim) FILTER (verdict = 'correct') AS supported FROM verdicts GROUP BY id),
o AS (SELECT q.id AS query_id, CASE WHEN known THEN category ELSE 'unknown' END AS category, CASE WHEN known THEN split ELSE 'unknown' END AS split, known, outcome = 'abstained' AND known AS abstained, NOT answerable OR NOT enough AS expected, CASE WHEN known THEN rejected ELSE 0 END AS malformed_marker, outcome,
    CASE WHEN known THEN (SELECT count(*) FROM t WHERE conv_id = q.id) ELSE 0 END AS expected_claims, coalesce((SELECT count(*) FROM asserted a WHERE a.id = q.id), 0) AS asserted_claims, coalesce(supported, 0) AS supported_claims, coalesce(cited, 0) AS cited,
    {', '.join(f'coalesce({x}, 0) AS {x}' for x in E.VERDICTS[:-1])} FROM q LEFT JOIN v USING (id)),
outcomes AS (SELECT query_id, category, split, CASE WHEN NOT known THEN 'unknown_query' WHEN outcome = 'provider_error' THEN 'provider_error' WHEN malformed_marker > 0 THEN 'malformed_citation' WHEN abstained AND NOT expected THEN 'spurious_abstention' WHEN NOT abstained AND expected THEN 'missing_abstention'
    WHEN NOT abstained AND cited = 0 THEN 'uncited' ELSE 'ok' END AS class, expected_claims, asserted_claims, supported_claims, asserted_claims - supported_claims AS unsupported_claims, cited + malformed_marker AS citations, {', '.join(E.VERDICTS[:-1])}, CAST(malformed_marker AS BIGINT) AS malformed_marker,
    abstained, known AND outcome <> 'provider_error' AND abstained = expected AS abstention_correct FROM o)"""


@query("r24_grounding_outcomes", f"WITH {_GROUNDING_SQL} SELECT * FROM outcomes")
def r24(spark, d):
    """The class, the claims and the citation verdicts of every case."""
    return E.evaluate(**grounding_inputs(spark, d), generation="g1")


@query("a14_grounding_metrics", f"""
WITH {_GROUNDING_SQL}
SELECT category, count(*) AS cases, {', '.join(f"CASE WHEN {w} > 0 THEN round({p} / {w}, 6) ELSE 0.0 END AS {n}" for n, p, w in (
    ('expected_claim_coverage', 'sum(asserted_claims)', 'sum(expected_claims)'), ('citation_precision', 'sum(correct)', 'sum(citations)'), ('citation_coverage', 'sum(supported_claims)', 'sum(asserted_claims)'), ('abstention_accuracy', 'count(*) FILTER (abstention_correct)', 'count(*)')))},
  CAST(sum(unsupported_claims) AS BIGINT) AS unsupported_claims, CAST(sum(citations) AS BIGINT) AS citations, {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in E.VERDICTS)}, {', '.join(f"count(*) FILTER (class = '{x}') AS class_{x}" for x in E.CLASSES)}
FROM outcomes GROUP BY ROLLUP (category)""")
def a14(spark, d):
    """Ratios, verdict and class histograms of all cases (null category) and of each category."""
    return E.report(E.evaluate(**grounding_inputs(spark, d), generation="g1"))
