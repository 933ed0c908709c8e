"""Quality rules with cross-document line frequency (operator 1), in built-in functions only.

Each text gives rule counts and the hashes of its normalised lines (lower case,
white space collapsed). A line's frequency in a host is the number of distinct
documents of that host which hold it; exact copies, under whatever id, are one
document, or else a page that was fetched often would be its own boilerplate.
Lines above both limits are boilerplate; a document that keeps too few of its
words without them is depleted and rejected.

Defined results: a null text counts as empty (no words, base_failed); a null
host is a host of its own; rows with equal or null ids are judged each on its
own; columns other than id, text and host are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm.common import materialize, scratch, table

#: The white space that separates words, and the symbols counted.
BLANK = r"[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
#: A line is boilerplate if more than this share of a host's documents hold it ...
MAX_LINE_SHARE = 0.05
#: ... and more documents than this: in fewer, chance repeats could pass for a share.
MAX_LINE_DOCS = 5
#: A document is depleted if less than this share of its words is left.
MIN_LEFT_SHARE = 0.3

#: Words in windows found twice or more: sort window hashes with their places,
#: keep places whose neighbour has an equal hash, and measure the union of
#: their windows. Arrays that a lambda reads are bound by an outer lambda once.
REPEATED = f"""
transform(array(filter(split(text, '{BLANK}+'), x -> x <> '')), w -> named_struct(
  'n_words', CAST(size(w) AS BIGINT),
  'n_repeat_words', CASE WHEN size(w) <= {WINDOW} THEN 0L ELSE
    transform(array(transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW})))), h ->
      CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
        transform(array(array_sort(transform(h, (x, i) -> struct(x, i)))), s ->
          transform(array(array_sort(transform(filter(s, (e, i) -> coalesce(get(s, i - 1).x = e.x, false) OR coalesce(get(s, i + 1).x = e.x, false)), e -> e.i))), p ->
            aggregate(p, named_struct('n', 0L, 'last', {-WINDOW}), (a, x) -> named_struct('n', a.n + least({WINDOW}, x - a.last), 'last', x), a -> a.n))[0])[0]
      END)[0]
  END))[0]
"""
LINES = rf"filter(split(text, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"
NORMAL = rf"trim(BOTH ' ' FROM lower(regexp_replace(x, '{BLANK}+', ' ')))"


def rule_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """row, id, host, text_hash, the rule counts, and lines: (hash, words) of each line with a word."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return source.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.expr(REPEATED).alias("words"),
        (F.length("text") - F.length(F.expr(r"regexp_replace(text, '[^\\x20\\x09-\\x0D]+', '')"))).cast("long").alias("word_chars"),
        F.length(F.expr(f"regexp_replace(text, '[^{SYMBOLS}]+', '')")).cast("long").alias("n_symbols"),
        F.expr(f"transform(array({LINES}), l -> CAST(size(l) - size(array_distinct(l)) AS BIGINT))[0]").alias("n_dup_lines"),
        F.expr(f"transform({LINES}, x -> named_struct('line', xxhash64({NORMAL}), 'words', size(filter(split(x, '{BLANK}+'), y -> y <> ''))))").alias("lines"),
    ).select("row", "id", "host", "text_hash", "words.n_words", "word_chars", "n_symbols", "n_dup_lines", "words.n_repeat_words", "lines")


def boilerplate_lines(counts: DataFrame, max_docs: int = MAX_LINE_DOCS, max_share: float = MAX_LINE_SHARE) -> DataFrame:
    """(host, line, n_docs) of lines in too many distinct texts of one host."""
    hosts = counts.groupBy("host").agg(F.countDistinct("text_hash").alias("host_docs"))
    lines = counts.select("host", "text_hash", F.explode(F.array_distinct("lines.line")).alias("line"))
    often = lines.groupBy("host", "line").agg(F.countDistinct("text_hash").alias("n_docs")).where(F.col("n_docs") > max_docs)
    return often.join(hosts, often["host"].eqNullSafe(hosts["host"])).where(F.col("n_docs") > max_share * F.col("host_docs")).select(often["host"], "line", "n_docs")


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_LINE_DOCS, max_share: float = MAX_LINE_SHARE, min_left_share: float = MIN_LEFT_SHARE) -> DataFrame:
    """Rule counts, boilerplate found, and the verdict on every row of ``docs``."""
    with scratch(docs.sparkSession) as stored:
        counts = stored(rule_counts(docs, id_col, text_col, host_col))
        return materialize(judged_counts(counts, id_col, max_docs, max_share, min_left_share))


def judged_counts(counts: DataFrame, id_col: str, max_docs: int, max_share: float, min_left_share: float) -> DataFrame:
    """The verdict on every row of ``rule_counts``."""
    often = boilerplate_lines(counts, max_docs, max_share).select(F.col("host").alias("of"), F.col("line").alias("often"))
    found = counts.select("row", "host", F.inline("lines")).join(often, F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("often")))
    removed = found.groupBy("row").agg(F.count("*").alias("n_boilerplate_lines"), F.sum("words").alias("n_boilerplate_words"))
    judged = counts.drop("lines", "text_hash").join(removed, "row", "left").fillna(0, ["n_boilerplate_lines", "n_boilerplate_words"])
    base_failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")
    left = F.col("n_words") - F.col("n_boilerplate_words")
    return judged.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_boilerplate_lines",
        "n_boilerplate_words",
        base_failed.alias("base_failed"),
        (~base_failed & (left >= MIN_WORDS) & (left >= min_left_share * F.col("n_words"))).alias("kept"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT row, i, list_slice(w, i, i + {WINDOW - 1}) AS g FROM (SELECT row, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY row),
lines AS (SELECT row, host, text, trim(lower(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS line,
                 len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
          FROM (SELECT row, host, text, unnest(l) AS x FROM d)),
often AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM lines GROUP BY host, line)
          JOIN (SELECT host, count(DISTINCT text) AS m FROM d GROUP BY host) USING (host)
          WHERE n > {MAX_LINE_DOCS} AND n > {MAX_LINE_SHARE} * m),
removed AS (SELECT row, count(*) AS bl, sum(words) AS bw FROM lines JOIN often USING (host, line) GROUP BY row),
j AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(bl, 0) AS BIGINT) AS n_boilerplate_lines, CAST(coalesce(bw, 0) AS BIGINT) AS n_boilerplate_words
  FROM d LEFT JOIN rep USING (row) LEFT JOIN removed USING (row))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
       AND n_words - n_boilerplate_words >= {MIN_WORDS} AND n_words - n_boilerplate_words >= {MIN_LEFT_SHARE} * n_words AS kept
FROM j
"""
