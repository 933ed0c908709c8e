"""Index generations as a state machine over immutable tables.

Every change returns new rows; the pointer from a source to its published
generation is the commit point and is written last by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def claim(sources: DataFrame, generations: DataFrame) -> DataFrame:
    """source_id of sources for which a new build may start: none is building."""
    building = generations.where("state = 'building'").select("source_id").distinct()
    return sources.join(building, "source_id", "left_anti").select("source_id")


def publish_check(generations: DataFrame, chunks: DataFrame) -> DataFrame:
    """generation_id, stored, publish_ok, reason: the first rule that refuses publication."""
    stored = chunks.groupBy("generation_id").agg(F.count("*").alias("stored"), F.count_if(F.col("content").isNull()).alias("missing"))
    both = generations.join(stored, "generation_id", "left").fillna(0, ["stored", "missing"])
    reason = (
        F.when(F.col("state") != "building", "not_building")
        .when(F.col("stored") == 0, "no_chunks")
        .when(F.col("missing") > 0, "missing_content")
        .when(F.col("stored") != F.col("expected_chunks"), "count_mismatch")
    )
    return both.select("generation_id", "stored", reason.isNull().alias("publish_ok"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def rollback_targets(sources: DataFrame, generations: DataFrame) -> DataFrame:
    """source_id, target: the newest other published generation with the active one's fingerprint."""
    current = sources.join(generations.select(F.col("generation_id").alias("active_generation_id"), F.col("fingerprint").alias("current")), "active_generation_id")
    others = current.select("source_id", "active_generation_id", "current").join(generations.where("state = 'published'"), "source_id")
    fits = others.where("generation_id <> active_generation_id AND fingerprint = current")
    newest = Window.partitionBy("source_id").orderBy(F.desc("created_at"), F.desc("generation_id"))
    return fits.withColumn("rank", F.row_number().over(newest)).where("rank = 1").select("source_id", F.col("generation_id").alias("target"))


def reclaimable(sources: DataFrame, generations: DataFrame, as_of: F.Column, hours: int = 24) -> DataFrame:
    """generation_id of generations that are neither active, a rollback target, building nor recent."""
    used = sources.select(F.col("active_generation_id").alias("generation_id")).union(rollback_targets(sources, generations).select("target"))
    old = generations.where((F.col("state") != "building") & (F.col("created_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(hours))))
    return old.join(used.where("generation_id IS NOT NULL"), "generation_id", "left_anti").select("generation_id")


def fail_stale(generations: DataFrame, as_of: F.Column, seconds: int = 1200) -> DataFrame:
    """The generations table after builds older than ``seconds`` have failed."""
    stale = (F.col("state") == "building") & (F.col("created_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds))))
    return generations.withColumn("state", F.when(stale, "failed").otherwise(F.col("state")))


def restore_status(sources: DataFrame, generations: DataFrame) -> DataFrame:
    """source_id, status after a failed build: ready if something is published, else error; unchanged while another build runs."""
    building = generations.where("state = 'building'").select("source_id").distinct().withColumn("busy", F.lit(True))
    both = sources.join(building, "source_id", "left")
    return both.select("source_id", F.when(F.col("busy"), F.col("status")).when(F.col("active_generation_id").isNotNull(), "ready").otherwise("error").alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The union of both tables with the highest version of every key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(version))
    return old.unionByName(new).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def reusable_embeddings(new_chunks: DataFrame, active_chunks: DataFrame, text: str = "content") -> DataFrame:
    """New chunks with the id of an active chunk of equal content, if any; the largest id wins."""
    old = active_chunks.where(F.length(text) > 0).select(F.sha2(text, 256).alias("hash"), F.struct("generation_id", "chunk_index").alias("place")).groupBy("hash").agg(F.max("place").alias("reuse"))
    return new_chunks.withColumn("hash", F.sha2(text, 256)).join(old, "hash", "left")


def record_plan(generations: DataFrame, plans: DataFrame) -> DataFrame:
    """The generations table after plans (generation_id, expected_chunks, chunking) are recorded with their generations."""
    new = plans.select("generation_id", F.col("expected_chunks").alias("_expected"), F.col("chunking").alias("_chunking"))
    old = F.col("chunking") if "chunking" in generations.columns else F.lit(None).cast("string")
    both = generations.join(new, "generation_id", "left")
    return both.withColumns({"expected_chunks": F.coalesce("_expected", "expected_chunks"), "chunking": F.coalesce("_chunking", old)}).drop("_expected", "_chunking")


def move_pointers(sources: DataFrame, moves: DataFrame) -> DataFrame:
    """The sources table after moves (source_id, generation_id, chunks): pointer, chunk count and status ready."""
    new = moves.select("source_id", F.col("generation_id").alias("_to"), F.col("chunks").alias("_chunks"))
    old = F.col("chunk_count") if "chunk_count" in sources.columns else F.lit(None).cast("bigint")
    both, moved = sources.join(new, "source_id", "left"), F.col("_to").isNotNull()
    return both.withColumns({
        "active_generation_id": F.coalesce("_to", "active_generation_id"),
        "chunk_count": F.when(moved, F.col("_chunks")).otherwise(old),
        "status": F.when(moved, "ready").otherwise(F.col("status")),
    }).drop("_to", "_chunks")


def backfill(sources: DataFrame, chunks: DataFrame, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """Published generations for chunks without one whose source has no pointer, and the sources table that points to them."""
    bare = sources.where("active_generation_id IS NULL").select("source_id")
    made = chunks.where("generation_id IS NULL").join(bare, "source_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("stored"))
    made = made.select(F.concat(F.lit("legacy-"), F.col("source_id")).alias("generation_id"), "source_id", F.lit("published").alias("state"), F.lit(fingerprint).alias("fingerprint"), "stored")
    pointed = sources.join(made.select("source_id", F.col("generation_id").alias("_to")), "source_id", "left")
    return made, pointed.withColumn("active_generation_id", F.coalesce("active_generation_id", "_to")).drop("_to")


def without(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows whose ``key`` is in ``gone``: a deletion that cascades."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}


def vector_problems(rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """Null, wrongly sized and non-finite vectors, and all rows, of each key."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.groupBy(key).agg(
        F.count_if(v.isNull()).alias("null_vectors"), F.count_if(F.size(v) != width).alias("wrong_width"), F.count_if(~finite).alias("non_finite"), F.count("*").alias("total")
    )


def cache_insert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache (source_id, content_hash, model, body) after one new row for each source.

    A source's rows under another hash or model are evicted; a new row whose
    (hash, model) is held already only takes that row over. Where several new
    rows share (hash, model), the largest source_id owns it with its body.
    """
    keys = ["content_hash", "model"]
    of = new.select("source_id", F.col("content_hash").alias("_hash"), F.col("model").alias("_model"))
    stays = F.col("_hash").isNull() | ((F.col("content_hash") == F.col("_hash")) & (F.col("model") == F.col("_model")))
    kept = cache.join(of, "source_id", "left").where(stays).drop("_hash", "_model")
    owner = new.groupBy(*keys).agg(F.max(F.struct("source_id", "body")).alias("_new"))
    both = kept.join(owner, keys, "full")
    return both.select(F.coalesce("_new.source_id", "source_id").alias("source_id"), *keys, F.coalesce("body", "_new.body").alias("body"))


def valid_provenance(provider: F.Column, model: F.Column, width: F.Column, prints: list[F.Column], schema_width: int = 1024) -> F.Column:
    """Whether a generation may be built: named provider and model, the schema's width, no print of the legacy backfill."""
    named = (F.trim(provider) != "") & (F.trim(model) != "")
    legacy = [~F.startswith(p, F.lit("legacy:")) for p in prints]
    ok = named & (width == schema_width)
    for p in legacy:
        ok = ok & p
    return F.coalesce(ok, F.lit(False))
