"""Whether an evaluation corpus is fit for use: every broken rule as a row (location, field, rule).

Inputs, each with one row an entry:

* ``sources``: source_id, notebook_id, source_type
* ``chunks``: chunk_id, source_id, index, content, span_start, span_end, parent_group
* ``questions``: question_id, notebook_id, category, answerable, question, and the
  arrays relevant_chunks, relevant_sources, forbidden_sources and claims (id,
  text, supported_by, markers)

Ids are strings. A null array is empty, a null text is empty, and a null
``answerable`` is false. Of rows that repeat an id all but one are violations,
and the one with the smallest notebook and source answers references. A question
of an unknown notebook is judged no further.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The supported source types, and shapes of values that no public corpus may hold.
SOURCE_TYPES = ("pdf", "web", "markdown", "text", "youtube", "docx", "epub")
SECRETS = {
    "email address": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "cloud access key": r"AKIA[0-9A-Z]{16}",
    "repository token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "web token": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "secret key": r"sk-[A-Za-z0-9]{16,}|[sp]k_live_[A-Za-z0-9]{8,}|xox[baprs]-[A-Za-z0-9-]{10,}",
    "bearer credential": r"(?i)bearer\s+[A-Za-z0-9._-]{16,}",
    "account id": r"(user_[A-Za-z0-9]{20,}|(cus|sub|acct)_[A-Za-z0-9]{10,})",
    "raw identifier": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
}
SEPARATOR_BYTES = 2


def secret_shape(text: Column) -> Column:
    """The first shape of ``SECRETS`` that the text holds, or null."""
    return F.coalesce(*[F.when(text.rlike(pattern), label) for label, pattern in SECRETS.items()])


def broken(rows: DataFrame, location: str, *rules: tuple[str, str, Column]) -> DataFrame:
    """(location, field, rule) for each rule (field, name, condition) that a row breaks, in one pass."""
    found = [F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(name).alias("rule"))) for field, name, condition in rules]
    return rows.select(F.col(location).cast("string").alias("location"), F.explode(F.array_compact(F.array(*found))).alias("v")).select("location", "v.*")


def repeats(rows: DataFrame, name: str, *keys: str, location: str | None = None) -> DataFrame:
    """A violation for each row but one of equal keys."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(location or keys[-1]).alias("at")).where("n > 1")
    field = "index" if "index" in keys else "id"
    return counted.select(F.col("at").cast("string").alias("location"), F.lit(field).alias("field"), F.lit(name).alias("rule"), F.explode(F.sequence(F.lit(2), "n"))).drop("col")


def blank(text: str) -> Column:
    return ~F.coalesce(F.col(text), F.lit("")).rlike(r"\S")


def structure(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Unique ids, known types, full contents, and spans that tile each source; of a source's misplaced chunks the first."""
    known = F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False))
    size = F.octet_length(F.coalesce("content", F.lit(""))).cast("long")
    ordered = Window.partitionBy("source_id").orderBy("index", "chunk_id")
    before = F.coalesce(F.sum(size + SEPARATOR_BYTES).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = F.col("span_start").eqNullSafe(F.col("from")) & F.col("span_end").eqNullSafe(F.col("from") + size)
    placed = chunks.withColumn("from", before).where(~fits).groupBy("source_id").agg(F.min_by("chunk_id", F.struct("index", "chunk_id")).alias("chunk_id"))
    parts = [
        repeats(sources, "duplicate", "source_id"),
        broken(sources, "source_id", ("source_type", "unknown type", ~known)),
        repeats(chunks, "duplicate", "chunk_id"),
        repeats(chunks, "duplicate", "source_id", "index", location="chunk_id"),
        broken(
            chunks, "chunk_id", ("content", "empty", blank("content")), ("span", "empty or inverted", F.coalesce(F.col("span_end") <= F.col("span_start"), F.lit(True))),
            ("parent_group", "empty", F.col("parent_group").isNotNull() & blank("parent_group")), ("content", "secret", secret_shape(F.col("content")).isNotNull()),
        ),
        broken(placed, "chunk_id", ("span", "misplaced", F.lit(True))),
    ]
    return reduce(DataFrame.unionByName, parts)


def labels(sources: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """References that resolve inside of the question's notebook, and labels that agree with each other."""
    filled = [F.coalesce(c, F.array().cast(questions.schema[c].dataType)).alias(c) for c in ("relevant_chunks", "relevant_sources", "forbidden_sources", "claims")]
    asked = questions.select("question_id", "notebook_id", "category", F.coalesce("answerable", F.lit(False)).alias("answerable"), "question", *filled)
    books = sources.select("notebook_id", F.lit(True).alias("known")).distinct()
    owner = sources.groupBy("source_id").agg(F.min("notebook_id").alias("owner"))
    place = chunks.groupBy("chunk_id").agg(F.min("source_id").alias("source_id")).join(owner, "source_id", "left")
    known = asked.join(books, "notebook_id", "left")
    judged = known.where("known")
    n = lambda c: F.size(c)
    own = [
        ("answerable", "unanswerable category", (F.col("category") == "unanswerable") & F.col("answerable")),
        ("relevant_chunks", "needs a chunk", F.col("answerable") & (n("relevant_chunks") == 0)),
        ("relevant_chunks", "must have none", ~F.col("answerable") & (n("relevant_chunks") > 0)),
        ("expected_claims", "must have none", ~F.col("answerable") & (n("claims") > 0)),
        ("expected_claims", "needs a claim", F.col("answerable") & (n("claims") == 0)),
        ("relevant_chunks", "needs two chunks", (F.col("category") == "multi_hop") & (n("relevant_chunks") < 2)),
        ("relevant_sources", "needs two sources", (F.col("category") == "conflicting_sources") & (n("relevant_sources") < 2)),
    ]
    cited = judged.select("question_id", "notebook_id", "relevant_sources", F.explode("relevant_chunks").alias("chunk_id")).join(place, "chunk_id", "left")
    listed = judged.select("question_id", F.explode("relevant_sources").alias("source_id")).join(owner, "source_id", "left")
    barred = judged.select("question_id", "notebook_id", "relevant_sources", F.explode("forbidden_sources").alias("source_id")).join(owner, "source_id", "left")
    claims = judged.select("question_id", "relevant_chunks", F.explode("claims").alias("c")).select("question_id", "relevant_chunks", "c.*")
    backed = claims.select("question_id", "relevant_chunks", F.explode("supported_by").alias("chunk_id")).join(place, "chunk_id", "left")
    there = F.col("owner").isNotNull()
    parts = [
        repeats(asked, "duplicate", "question_id"),
        broken(known, "question_id", ("query", "empty", blank("question")), ("query", "secret", secret_shape(F.col("question")).isNotNull()), ("notebook", "unknown", F.col("known").isNull())),
        broken(judged, "question_id", *own),
        broken(cited, "question_id", ("relevant_chunks", "unknown", ~there), ("relevant_chunks", "other notebook", F.col("owner") != F.col("notebook_id")), ("relevant_sources", "source not listed", there & ~F.array_contains("relevant_sources", F.col("source_id")))),
        broken(listed, "question_id", ("relevant_sources", "unknown", ~there)),
        broken(barred, "question_id", ("forbidden_sources", "unknown", ~there), ("forbidden_sources", "relevant too", there & F.array_contains("relevant_sources", F.col("source_id"))), ("forbidden_sources", "own notebook", F.col("owner") == F.col("notebook_id"))),
        repeats(claims.select("question_id", "id"), "duplicate claim", "question_id", "id", location="question_id"),
        broken(claims, "question_id", ("expected_claims.answer_markers", "none", F.coalesce(n("markers"), F.lit(0)) <= 0), ("expected_claims.supported_by", "none", F.coalesce(n("supported_by"), F.lit(0)) <= 0), ("expected_claims.text", "secret", secret_shape(F.col("text")).isNotNull())),
        broken(backed, "question_id", ("expected_claims.supported_by", "unknown", ~there), ("expected_claims.supported_by", "not relevant", there & ~F.array_contains("relevant_chunks", F.col("chunk_id")))),
    ]
    return reduce(DataFrame.unionByName, parts)


def coverage(questions: DataFrame, categories: tuple[str, ...], min_total: int, min_each: int) -> DataFrame:
    """Too few questions in all, or in a category; categories are a short, fixed list."""
    counts = questions.agg(F.count("*").alias("all"), *[F.count_if(F.col("category") == c).alias(c) for c in categories]).withColumn("at", F.lit("<corpus>"))
    return broken(counts, "at", ("queries", "too few", F.col("all") < min_total), *[(f"category {c}", "too few", F.col(c) < min_each) for c in categories])


def violations(sources: DataFrame, chunks: DataFrame, questions: DataFrame, categories: tuple[str, ...], min_total: int, min_each: int) -> DataFrame:
    """location, field, rule of everything that is wrong with a corpus; no row if it is fit for use."""
    return structure(sources, chunks).unionByName(labels(sources, chunks, questions)).unionByName(coverage(questions, categories, min_total, min_each))
