"""MinHash near-duplicate detection with odd sketches (operator 9).

1. Each text becomes the set of its distinct 5-word shingles (64-bit hashes),
   128 MinHash samples, 32 band keys of 4 samples each, and an odd sketch: a
   512-bit parity bitmap into which every sample is folded by XOR.
2. Documents with equal sets form one class, named by the digest of the set;
   only one text of each class goes on. Classes that one id has are linked.
   Classes and buckets are dealt to SALTS parts by the hash of their members, so
   that neither thousands of copies nor a hot bucket meet in one task.
3. Every member of a part is compared with the part's
   hub, the member that shares most buckets with most documents, and the hubs
   of a bucket with the greatest of them: a linear number of pairs. A pair is
   dropped if its set sizes or its odd sketches, by the population count of
   their XOR, rule out the similarity; the full sets of all others are
   intersected. Verified pairs are joined into components.
4. Only pairs of one bucket that still lie in different components are left.
   The number of shingles that no other of their documents has bounds every
   intersection from above: documents that cannot reach the similarity with any
   other leave. The rest get sharper odd sketches (1024 samples in 4096 bits);
   pairs that pass both, each taken in its first common band, are verified.

A pair at similarity 0.75 shares no bucket with probability
(1 - 0.75 ** 4) ** 32 = 5e-6; nothing is capped.

Defined results: texts without words (null too) have an empty set and are
linked with nothing; fewer than five words make one shingle. Rows of equal id
are one document: each of its texts counts, and all of them are in one
component, whatever the order of the rows. Rows without an id form no links:
component_id is null, kept true.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docloom.llm.common import append_columns, lookup, materialize, scratch, slices, table

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 4
#: Parts of a class or bucket; each is handled on its own, and a bucket by the hubs of its parts.
SALTS = 64
SKETCH_LONGS = 8
#: Odd-sketch estimates below these drop a pair: over five standard deviations under 0.75.
SKETCH_FLOOR, SHARP_FLOOR = 0.5, 0.65
SHARP_SAMPLES, SHARP_LONGS = 1024, 64
FILTER_BITS = 1 << 26
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAMPLES = np.random.default_rng(20240229)
_FACTORS = _SAMPLES.integers(0, 1 << 32, SHARP_SAMPLES, dtype=np.uint32) | np.uint32(1)
_OFFSETS = _SAMPLES.integers(0, 1 << 32, SHARP_SAMPLES, dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well-spread bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles; A-Z is lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for k in range(min(size, len(words))):
        out = mix(out * _MIX + hashes[k : k + n])
    return np.unique(out)


def min_hashes(shingles: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    """One minimum for each hash function, in bounded memory."""
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(samples, 0xFFFFFFFF, np.uint32)
    block = (1 << 18) // samples
    for start in range(0, len(low), block):
        part = low[start : start + block, None] * _FACTORS[:samples]
        part ^= _OFFSETS[:samples]
        np.minimum(out, part.min(axis=0), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * _MIX + rows[:, k])
    return out.view(np.int64)


def odd_sketch(samples: np.ndarray, longs: int = SKETCH_LONGS) -> np.ndarray:
    """A bitmap in which a bit is set if an odd number of samples falls on it."""
    at = mix(samples.astype(np.uint64) * _MIX + np.arange(len(samples), dtype=np.uint64)) % np.uint64(64 * longs)
    odd = (np.bincount(at.astype(np.int64), minlength=64 * longs) & 1).astype(np.uint8)
    return np.packbits(odd).view(">i8").astype(np.int64)


def set_digest(shingles: np.ndarray) -> bytes | None:
    """128 bits that name a set; None if it is empty."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text), n_shingles, fp (digest of the whole set; null if empty), bands, sketch."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))]

    def make():
        def work(texts):
            out = [[], [], [], []]
            for text in texts:
                found = shingle_set(text)
                samples = min_hashes(found) if len(found) else None
                row = (len(found), set_digest(found), band_keys(samples), odd_sketch(samples)) if len(found) else (0, None, None, None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return work

    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return append_columns(source, "text", fields, make, binary=True, drop=("text",))


def estimate(left: str, right: str, samples: int, longs: int) -> Column:
    """Similarity by the odd-sketch formula from the population count of the XOR of two sketches."""
    apart = sum((F.bit_count(F.col(f"{left}.sketch")[k].bitwiseXOR(F.col(f"{right}.sketch")[k])) for k in range(longs)), F.lit(0))
    bits = 64 * longs
    return 1 + F.lit(bits / (4.0 * samples)) * F.log(F.greatest(1 - 2 * apart / F.lit(float(bits)), F.lit(1e-9)))


def plausible(left: str, right: str, percent: int) -> Column:
    """Whether set sizes and sketches leave room for the similarity."""
    a, b = F.col(f"{left}.n"), F.col(f"{right}.n")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (estimate(left, right, BANDS * ROWS, SKETCH_LONGS) >= SKETCH_FLOOR)


def sharply_plausible(left: str, right: str, percent: int) -> Column:
    """Whether shingles that others have too, and sharper sketches, leave room for the similarity."""
    shared = F.least(F.col(f"{left}.n") - F.col(f"{left}.own"), F.col(f"{right}.n") - F.col(f"{right}.own"))
    union = F.col(f"{left}.n") + F.col(f"{right}.n") - shared
    return (100 * shared >= percent * union) & (estimate(left, right, SHARP_SAMPLES, SHARP_LONGS) >= SHARP_FLOOR)


def first_common_band(left: str, right: str, key: Column) -> Column:
    """Whether ``key`` is the first band key that both have: each pair is taken in one bucket only."""
    same = F.zip_with(F.col(f"{left}.bands"), F.col(f"{right}.bands"), lambda x, y: x == y)
    return F.get(F.col(f"{left}.bands"), (F.array_position(same, True) - 1).cast("int")) == key


def own_shingles(sets: DataFrame) -> DataFrame:
    """id, n, own: set size, and how many of its shingles no other of these sets has."""
    single = sets.select("id", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    own = single.groupBy("id").agg(F.count("*").alias("own"))
    return sets.select("id", F.size("items").cast("long").alias("n")).join(own, "id", "left").fillna(0, ["own"])


def mixed_buckets(entries: DataFrame) -> DataFrame:
    """The entries (key, salt, component and others) of buckets that hold more than one component."""
    parts = entries.groupBy("key", "salt").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    mixed = parts.groupBy("key").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x <> y").select("key")
    return entries.join(parts.select("key", "salt").join(mixed, "key", "left_semi"), ["key", "salt"], "left_semi")


def sharp_sketches(sets: DataFrame) -> DataFrame:
    """id and the sharper odd sketch of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "items"):
                made = [odd_sketch(min_hashes(x.values.to_numpy().view(np.uint64), SHARP_SAMPLES), SHARP_LONGS) for x in batch.column("items")]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.list_(pa.int64()))], names=["id", "sketch"])

    schema = T.StructType([sets.schema["id"], T.StructField("sketch", T.ArrayType(T.LongType()))])
    return sets.select("id", "items").mapInArrow(run, schema)


def place_slot(id_col: str, text_hash: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text_hash), F.lit(FILTER_BITS))


def place_filter(wanted: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits over the hashes of (rep, th): of fixed size, with false positives but no false negatives."""
    slot = place_slot("rep", F.col("th"))
    words = wanted.select(slot.alias("slot")).selectExpr("shiftright(slot, 6) AS word", "shiftleft(1L, CAST(slot % 64 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for batch in words.toArrow().to_batches():  # at most FILTER_BITS / 64 rows
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return out


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """id (of a class) and items, the whole shingle set, of the wanted classes. Texts are read in place; only sets are shuffled."""
    places = classes.join(wanted.select(F.col("id").alias("fp")), "fp", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(place_filter(places))
    text = F.col(f"`{text_col}`")
    source = docs.where(F.col(f"`{id_col}`").isNotNull()).select(place_slot(id_col, F.xxhash64(text)).alias("slot"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for whole in batches:
            slot = whole.column("slot").to_numpy()
            chosen = whole.filter(pa.array((bits[slot >> 6] >> (slot & 63)) & 1 == 1))
            for batch in slices(chosen, "text"):
                sets = [shingle_set(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                names = [set_digest(x) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["id", "items"])

    found = source.mapInArrow(run, "id binary, items array<bigint>")
    return found.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("right")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("left")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "right"):
                keep = []
                for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                    x, y = (side.values.to_numpy().view(np.uint64) for side in (left, right))
                    at = np.searchsorted(y, x)
                    shared = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                    keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(check, pairs.select("a", "b").schema)


def components(edges: DataFrame, stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, component): each linked id with the smallest id of its component.

    Alternates large-star and small-star steps, each a join and an aggregation,
    until no edge changes; every step is written to the shared folder.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = stored(small)
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now


def hub_pairs(reps: DataFrame, stored: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The entries (key, salt, id, size) of buckets with more than one member, and the pairs of members and hubs."""
    entries = reps.select("id", F.explode("bands").alias("key"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = entries.groupBy("key", "salt").agg(F.count("*").alias("part"))
    sizes = parts.groupBy("key").agg(F.sum("part").alias("size")).where("size > 1")
    grouped = stored(entries.join(parts.join(sizes, "key").select("key", "salt", "size"), ["key", "salt"]))
    mass = grouped.groupBy("id").agg(F.sum("size").alias("mass"))
    hubs = stored(grouped.join(mass, "id").groupBy("key", "salt").agg(F.max(F.struct("mass", "id")).alias("hub")))
    heads = hubs.groupBy("key").agg(F.max("hub").alias("head"))
    near = grouped.join(hubs, ["key", "salt"]).select("id", F.col("hub.id").alias("hub"))
    across = hubs.join(heads, "key").select(F.col("hub.id").alias("id"), F.col("head.id").alias("hub"))
    pairs = near.union(across).where("hub <> id").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    return grouped, pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row for each row of ``docs``: id_col, n_shingles, component_id, kept."""
    with scratch(docs.sparkSession) as stored:
        return materialize(linked_rows(docs, id_col, text_col, percent, stored))


def linked_rows(docs: DataFrame, id_col: str, text_col: str, percent: int, stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows = stored(sketches(docs, id_col, text_col)).withColumn("salt", F.pmod(F.xxhash64("id", "th"), F.lit(SALTS)).cast("int"))
    linkable = rows.where("id IS NOT NULL AND fp IS NOT NULL")
    parts = stored(linkable.groupBy("fp", "salt").agg(F.min(F.struct("id", "th")).alias("first"), F.count("*").alias("n")))
    whole = parts.groupBy("fp").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    classes = stored(whole.select("fp", F.col("first.id").alias("rep"), F.col("first.th").alias("th"), "n"))
    of_parts = parts.select("fp", "salt").join(classes.where("n > 1").select("fp", "rep", F.col("th").alias("at")), "fp")
    alone = linkable.join(of_parts, ["fp", "salt"], "left").where("rep IS NULL OR (rep = id AND at = th)")
    reps = alone.select(F.col("fp").alias("id"), F.col("n_shingles").alias("n"), "sketch", "bands").dropDuplicates(["id"])
    twice = linkable.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    same_id = linkable.select("id", F.col("fp").alias("b")).join(twice.select("id", "a"), "id").select("a", "b").where("a <> b").distinct()

    grouped, pairs = hub_pairs(reps, stored)
    wanted = stored(grouped.select("id").distinct())
    traits = stored(reps.select("id", F.struct("n", "sketch").alias("traits")).join(wanted, "id", "left_semi"))
    candidates = stored(with_traits(pairs, traits).where(plausible("ta", "tb", percent)).select("a", "b"))
    paired = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stored(shingle_sets(docs, id_col, text_col, paired, classes))
    found = components(verified(candidates, sets, percent).union(same_id), stored)

    labelled = grouped.select("key", "salt", "id").join(found, "id", "left").select("key", "salt", "id", F.coalesce("component", "id").alias("component"))
    rest = stored(mixed_buckets(labelled))
    of_rest = stored(shingle_sets(docs, id_col, text_col, rest.select("id").distinct(), classes))
    able = stored(own_shingles(of_rest).where(f"100 * (n - own) >= {percent} * n"))
    rest = stored(mixed_buckets(rest.join(able.select("id"), "id", "left_semi").select("key", "salt", "component", "id")))
    sharp = sharp_sketches(of_rest.join(rest.select("id").distinct(), "id", "left_semi")).join(able, "id").join(reps.select("id", "bands"), "id")
    sharp = stored(sharp.dropDuplicates(["id"]).select("id", F.struct("n", "own", "sketch", "bands").alias("traits")))
    rest = rest.join(sharp, "id")
    left = rest.select("key", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("traits").alias("ta"))
    right = rest.select("key", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("traits").alias("tb"))
    pair = (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
    across = left.join(right, pair & sharply_plausible("ta", "tb", percent) & first_common_band("ta", "tb", left["key"]))
    more = across.select("a", "b").distinct().join(candidates, ["a", "b"], "left_anti")
    late = stored(verified(more, of_rest, percent))
    if not late.isEmpty():  # join whole components by the links found between them
        of = found.select("id", "component")
        ends = late.join(of.select(F.col("id").alias("a"), F.col("component").alias("x")), "a", "left").join(of.select(F.col("id").alias("b"), F.col("component").alias("y")), "b", "left")
        merged = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")), stored)
        found = found.join(merged.select(F.col("id").alias("component"), F.col("component").alias("lower")), "component", "left").select("id", F.coalesce("lower", "component").alias("component"))
        found = stored(found.union(merged.select("id", "component")).groupBy("id").agg(F.min("component").alias("component")))

    named = classes.select("fp", "rep").join(found.select(F.col("id").alias("fp"), "component"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("lowest"), F.count("*").alias("n"))
    of_class = named.join(lowest.where("n > 1"), "component", "left").select("fp", F.coalesce("lowest", "rep").alias("lowest"))
    of_part = stored(parts.select("fp", "salt").join(of_class, "fp").withColumnsRenamed({"fp": "class", "salt": "part"}))
    out = rows.select("id", "n_shingles", "fp", "salt").join(of_part, (F.col("fp") == F.col("class")) & (F.col("salt") == F.col("part")), "left").select("id", "n_shingles", "lowest")
    # an empty text of an id that has others too is in their component: all classes of an id are linked, so any of them tells it
    bare = rows.where("id IS NOT NULL AND fp IS NULL").select("id").distinct()
    held = linkable.join(bare, "id", "left_semi").groupBy("id").agg(F.min(F.struct("fp", "salt")).alias("of"))
    of_bare = stored(held.join(of_part, (F.col("of.fp") == F.col("class")) & (F.col("of.salt") == F.col("part"))).select("id", F.col("lowest").alias("low")))
    if not of_bare.isEmpty():
        out = lookup(out, of_bare, ["id"], "left").select("id", "n_shingles", F.coalesce("lowest", "low").alias("lowest"))
    lowest = F.when(F.col("id").isNotNull(), F.coalesce("lowest", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", lowest.alias("component_id"), F.coalesce(lowest == F.col("id"), F.lit(True)).alias("kept"))


def with_traits(pairs: DataFrame, traits: DataFrame) -> DataFrame:
    one = traits.select(F.col("id").alias("a"), F.col("traits").alias("ta"))
    two = traits.select(F.col("id").alias("b"), F.col("traits").alias("tb"))
    return pairs.join(two, "b").join(one, "a")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
