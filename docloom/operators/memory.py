"""Memory analytics (decay, resolution, selection) and interaction-log metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions.text import strip, strip_fences


def decayed(salience: Column, days: Column) -> Column:
    """Salience after whole weeks of rest: 5 % less each week, unchanged in the first."""
    return F.when(days < 7, salience).otherwise(F.least(F.greatest(salience * F.pow(F.lit(0.95), F.floor(days / 7)), F.lit(0.0)), F.lit(1.0)))


def decay(memories: DataFrame, as_of: Column, floor: float = 0.1) -> DataFrame:
    """memory_id, salience, dropped: summaries do not decay; the rest goes once it is below the floor."""
    days = F.timestamp_diff("DAY", F.col("updated_at").cast("timestamp_ntz"), as_of)
    now = F.when(F.col("kind") == "summary", F.col("salience")).otherwise(decayed(F.col("salience"), days))
    return memories.select("memory_id", F.round(now, 9).alias("salience"), ((F.col("kind") != "summary") & (now < floor)).alias("dropped"))


def resolve(similar: DataFrame) -> DataFrame:
    """question, action, target, salience by the most similar old memory: above 0.97 skip, from 0.90 update, else insert."""
    best = similar.groupBy("question", "new_salience").agg(F.max_by(F.struct("chunk_id", "score", "salience"), F.struct("score", "chunk_id")).alias("b"))
    score = F.coalesce(F.col("b.score"), F.lit(0.0))
    action = F.when(score > 0.97, "skip").when(score >= 0.90, "update").otherwise("insert")
    merged = F.least((F.col("b.salience") * 0.7 + F.col("new_salience") * 0.3) * 1.05, F.lit(1.0))
    return best.select("question", action.alias("action"), F.when(action != "insert", F.col("b.chunk_id")).alias("target"), F.round(F.when(action == "update", merged).otherwise(F.col("new_salience")), 6).alias("salience"))


def core_memories(memories: DataFrame, owner: str, limit: int = 15) -> DataFrame:
    """The most salient memories of each owner that go into every prompt."""
    order = Window.partitionBy(owner).orderBy(F.desc("salience"), F.desc("updated_at"), "memory_id")
    kept = memories.where(F.col("kind").isin("expertise", "goal", "preference") & (F.col("salience") > 0.5))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def keep_newest(memories: DataFrame, owner: str, kind: str, n: int) -> DataFrame:
    """Without all but the newest ``n`` memories of one kind for each owner."""
    order = Window.partitionBy(owner, "kind").orderBy(F.desc("updated_at"), F.desc("memory_id"))
    return memories.withColumn("_age", F.row_number().over(order)).where((F.col("kind") != kind) | (F.col("_age") <= n)).drop("_age")


def log_metrics(logs: DataFrame, as_of: Column, days: int, key: str) -> DataFrame:
    """Counts, averages and rates of the interactions of each key in the last ``days`` days."""
    recent = logs.where(F.col("ts") > as_of - F.make_dt_interval(F.lit(days)))
    out = recent.groupBy(key).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("relevance") > 0.5).alias("good"),
        F.round(F.avg("relevance"), 6).alias("avg_relevance"),
        F.count_if(F.col("feedback") == 1).alias("positive"),
        F.count_if(F.col("feedback") == -1).alias("negative"),
    )
    rate = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(100.0 * a / b), 6)
    return out.withColumn("success_rate", rate(F.col("good"), F.col("total"))).withColumn("positive_rate", rate(F.col("positive"), F.col("positive") + F.col("negative")))


def provider_metrics(calls: DataFrame, provider: str, latency: str, failed: Column) -> DataFrame:
    """Calls, latency range and error rate of each provider."""
    return calls.groupBy(provider).agg(
        F.count("*").alias("calls"),
        F.round(F.avg(latency), 6).alias("avg_latency"),
        F.min(latency).alias("min_latency"),
        F.max(latency).alias("max_latency"),
        F.round(F.avg(failed.cast("double")), 6).alias("error_rate"),
    )


def budget(window: Column, output: Column) -> Column:
    """Bytes left for a prompt: the window less a reserve of a twentieth (1024 at least), the output and 16."""
    return F.greatest(window - F.greatest(F.lit(1024), F.floor(window / 20)) - output - 16, F.lit(0))


def fit_evidence(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """key, admitted, used: ranked entries take their parent's cost, else their child's, and admission stops at the first that fits neither.

    rows: key, rank, parent_cost, child_cost. Entries of one key are a prompt's pool and bounded by it.
    """
    entries = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "parent_cost", "child_cost"))).alias("e"))
    step = f"""(s, x) -> CASE
      WHEN s.stopped THEN s
      WHEN s.used + x.parent_cost <= {limit} THEN named_struct('used', s.used + x.parent_cost, 'admitted', s.admitted + 1L, 'stopped', false)
      WHEN s.used + x.child_cost <= {limit} THEN named_struct('used', s.used + x.child_cost, 'admitted', s.admitted + 1L, 'stopped', false)
      ELSE named_struct('used', s.used, 'admitted', s.admitted, 'stopped', true) END"""
    state = F.expr(f"aggregate(e, named_struct('used', 0L, 'admitted', 0L, 'stopped', false), {step})")
    return entries.select(key, state.alias("s")).select(key, "s.admitted", "s.used")


#: The kinds of memory.
KINDS = ["fact", "preference", "summary", "expertise", "goal", "conversation_summary"]


def parsed_memories(replies: DataFrame, key: str, raw: str) -> DataFrame:
    """key, pos, content, memory_type, salience, metadata of the valid memories in replies of JSON.

    Valid is a content of 1 to 500 bytes after trimming, and a known kind.
    Salience is 0.7 by default and held in 0 to 1; a context of 1 to 200 bytes
    goes to the metadata. Replies that are no JSON give no row.
    """
    schema = "struct<memories: array<struct<content: string, memory_type: string, salience: double, context: string>>>"
    each = replies.select(key, F.posexplode(F.from_json(strip_fences(F.col(raw)), schema)["memories"]).alias("pos", "m"))
    content, context = strip(F.col("m.content")), strip(F.col("m.context"))
    topic = F.when(F.octet_length(context).between(1, 200), context)
    metadata = F.to_json(F.struct(F.lit("chat_extraction").alias("source"), topic.alias("extracted_from_topic")))
    salience = F.least(F.greatest(F.coalesce("m.salience", F.lit(0.7)), F.lit(0.0)), F.lit(1.0))
    valid = F.octet_length(content).between(1, 500) & F.col("m.memory_type").isin(*KINDS)
    return each.where(valid).select(key, "pos", content.alias("content"), "m.memory_type", salience.alias("salience"), metadata.alias("metadata"))


def preferred_sources(logs: DataFrame, key: str, retrieved: str) -> DataFrame:
    """key, source_id: the distinct sources in the retrieved JSON of logs with positive feedback."""
    each = logs.where("feedback = 1").select(key, F.explode(F.from_json(F.col(retrieved), "array<struct<source_id: string>>")).alias("chunk"))
    return each.select(key, "chunk.source_id").where("source_id IS NOT NULL").distinct()
