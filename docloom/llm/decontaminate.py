"""Benchmark decontamination by a prefix-filtered set join (operator 6).

Every benchmark item is cut into windows of 13 consecutive words (a shorter item
is one window). A document contains a window only if it contains the window's
rarest word, so under exact containment the necessary prefix is one token.

1. Words are ordered by rarity: in how many documents each occurs, counted over
   all documents in SLOTS counters by the words' hashes. Words that share a
   counter look more frequent than they are, which costs time but no match.
2. Each window is indexed by its rarest word: the word's slot, and the places
   (or, for shorter windows, the lengths) that such windows have there.
3. Where a document has a word of such a slot, the windows that can lie around
   it are bounded by position and length; those whose hash is in a bitmap of all
   windows' hashes become candidates.
4. Candidates are joined with the windows by their words, which is exact, and
   grouped by text. Texts with a hit are a table of their own, which is counted:
   a small one is sent to the documents, a larger one is joined with split keys,
   so neither copies of a text nor null texts meet in one task.

Counters, places and bitmap have a fixed size, whatever the benchmark's; false
positives of theirs end in step 4. Documents and windows meet in joins only. The
windows and the texts with a hit stay in the shared folder, as results read them.

Defined results: null or empty texts have no words, are never hit and are not
contaminated; items without words or without an id are ignored; repeated items
count once by id; repeated documents are judged each on its own; columns of the
input named like the new ones, in any case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docloom.llm.common import append_columns, lookup, materialize, slices, table, unused

WINDOW = 13
#: Counters of word frequencies, and bits of the bitmap over window hashes: both are sent to every task.
SLOTS, BITS = 1 << 20, 1 << 26
#: Words remembered by one Python worker.
CACHE_ENTRIES = 400_000
#: A word is a run of these bytes: ASCII letters and digits, and all of UTF-8 beyond ASCII.
WORD_BYTES = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(WORD_BYTES).split() if text else []


class Remembered(dict):
    """word -> what ``find`` makes of its slot; fills itself, within a bound."""

    def __init__(self, slots: int, find):
        super().__init__()
        self.slots, self.find = slots, find

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = self[word] = self.find(xxhash.xxh3_64_intdigest(word) % self.slots)
        return found


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """window (its words, parted by blanks), item: every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text)
                rows += [(b" ".join(words[k : k + size]), item) for k in range(max(1, len(words) - size + 1) if words else 0)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["window", "item"])

    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "window binary, item string").distinct()


def slot_frequencies(docs: DataFrame, text_col: str, windows: DataFrame, slots: int) -> np.ndarray:
    """In how many documents the words of each slot occur, over all documents; -1 for slots of no window."""

    def of_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = Remembered(slots, int)
        for batch in batches:
            found = {slot[w] for window in batch.column("window").to_pylist() for w in window.split(b" ")}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["slot"])

    used = np.zeros(slots, np.bool_)
    used[windows.select("window").mapInArrow(of_windows, "slot bigint").distinct().toArrow().column("slot").to_numpy()] = True  # at most ``slots`` rows
    shared = docs.sparkSession.sparkContext.broadcast(used)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = shared.value, np.zeros(slots, np.int64)
        slot = Remembered(slots, lambda k: k if wanted[k] else -1)
        for whole in batches:
            for batch in slices(whole, "t"):
                for text in batch.column("t").cast(pa.binary()).to_pylist():
                    held = set(map(slot.__getitem__, set(words_of(text))))
                    held.discard(-1)
                    counts[list(held)] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])

    rows = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.where(used, 0, -1)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def prefix_index(windows: DataFrame, frequency: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each slot, the places of full windows (low bits) and the lengths of shorter ones (high bits) with their rarest word there; and the bitmap of window hashes."""
    slots = len(frequency)
    shared = windows.sparkSession.sparkContext.broadcast(frequency)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, often = Remembered(slots, int), shared.value
        for batch in batches:
            rows = []
            for window in batch.column("window").to_pylist():
                words = window.split(b" ")
                rarest = min(words, key=lambda w: (often[slot[w]], w))
                if often[slot[rarest]] > 0:  # else no document can contain the window
                    at = xxhash.xxh3_64_intdigest(window) % bits
                    for place, word in enumerate(words):
                        if word == rarest:
                            rows.append((slot[word], 1 << place if len(words) == size else 1 << (size + len(words)), at >> 6, int(np.uint64(1 << (at & 63)).view(np.int64))))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["slot", "mask", "word", "bit"])

    rows = windows.select("window").distinct().mapInArrow(index, "slot bigint, mask bigint, word bigint, bit bigint")
    both = rows.selectExpr("inline(array(struct(0 AS kind, slot AS at, mask AS bits), struct(1 AS kind, word AS at, bit AS bits)))").groupBy("kind", "at").agg(F.bit_or("bits").alias("bits"))
    places, bitmap = np.zeros(slots, np.int64), np.zeros(bits // 64, np.int64)
    found = both.toArrow()  # at most slots + bits / 64 rows
    kind, at, value = (found.column(c).to_numpy() for c in ("kind", "at", "bits"))
    places[at[kind == 0]], bitmap[at[kind == 1]] = value[kind == 0], value[kind == 1]
    return places, bitmap


def spans(words: list[bytes], masks: Remembered, bitmap: np.ndarray, size: int, bits: int) -> dict[tuple[int, int], bytes]:
    """(start, length) -> words of the windows that may be the benchmark's."""
    out: dict[tuple[int, int], bytes] = {}
    marks = np.fromiter(map(masks.__getitem__, words), np.int64, len(words))
    for at in np.flatnonzero(marks).tolist():
        mask = int(marks[at])
        starts = [(at - place, size) for place in range(size) if mask >> place & 1]
        starts += [(at - place, n) for n in range(1, size) if mask >> (size + n) & 1 for place in range(n)]
        for start, n in starts:
            if start >= 0 and start + n <= len(words) and (start, n) not in out:
                window = b" ".join(words[start : start + n])
                k = xxhash.xxh3_64_intdigest(window) % bits
                if int(bitmap[k >> 6]) >> (k & 63) & 1:
                    out[start, n] = window
    return out


def text_key(text_col: str) -> Column:
    """128 bits that stand for a text."""
    text = F.col(f"`{text_col}`")
    return F.struct(F.xxhash64(text).alias("one"), F.xxhash64(F.lit(7), text).alias("two"))


def window_hits(docs: DataFrame, items: DataFrame, text_col: str, item_id_col: str, item_text_col: str, window: int, slots: int, bits: int) -> DataFrame:
    """key (of ``text_key``), n_words, n_hit and item_ids of every text that holds a window."""
    windows = materialize(item_windows(items, item_id_col, item_text_col, window))
    index = prefix_index(windows, slot_frequencies(docs, text_col, windows, slots), window, bits)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # 8 bytes a slot, and the bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, bitmap = shared.value
        masks = Remembered(slots, lambda k: int(places[k]))
        for whole in batches:
            for batch in slices(whole, "t"):
                rows = []
                for row, text in enumerate(batch.column("t").cast(pa.binary()).to_pylist()):
                    words = words_of(text)
                    rows += [(row, len(words), start, n, found) for (start, n), found in spans(words, masks, bitmap, window, bits).items()]
                of, counts, starts, sizes, texts = list(zip(*rows)) or [[]] * 5
                made = [batch.column("key").take(pa.array(of, pa.int64()))]
                made += [pa.array(c, pa.int64()) for c in (counts, starts, sizes)] + [pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["key", "n_words", "start", "size", "window"])

    source = docs.select(text_key(text_col).alias("key"), F.col(f"`{text_col}`").alias("t"))
    found = source.mapInArrow(run, "key struct<one: bigint, two: bigint>, n_words bigint, start bigint, size bigint, window binary")
    hit = lookup(found, windows, ["window"]).groupBy("key").agg(F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    covered = "aggregate(spans, named_struct('n', 0L, 'end', 0L), (a, s) -> named_struct('n', a.n + greatest(0L, s.start + s.size - greatest(s.start, a.end)), 'end', greatest(a.end, s.start + s.size)), a -> a.n)"
    return materialize(hit.select("key", "n_words", F.expr(covered).alias("n_hit"), "item_ids"))


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"
MADE = ("n_words", "n_hit", "item_ids", "contaminated")


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slots: int = SLOTS, bits: int = BITS, keep_text: bool = True) -> DataFrame:
    """``docs``, with its text or without, with n_words, n_hit, item_ids (sorted as strings) and contaminated.

    A document is contaminated if windows cover a twentieth of its words or more.
    """
    kept = [c for c in docs.columns if c.lower() not in MADE and (keep_text or c != text_col)]
    key, hit, ids, body = (unused(c) for c in ("key", "hit", "ids", "body"))
    hits = window_hits(docs, items, text_col, item_id_col, item_text_col, window, slots, bits).select(F.col("key").alias(key), F.col("n_hit").alias(hit), F.col("item_ids").alias(ids))
    source = docs.select(*[F.col(f"`{c}`") for c in kept], text_key(text_col).alias(key), F.col(f"`{text_col}`").alias(body))
    source = append_columns(source, body, [T.StructField("n_words", T.LongType())], lambda: lambda texts: [[len(words_of(t)) for t in texts]], binary=True, drop=(body,))
    both = lookup(source, hits, [key], "left")
    made = both.select(*[F.col(f"`{c}`") for c in kept], "n_words", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce(ids, F.array().cast("array<string>")).alias("item_ids"))
    return made.withColumn("contaminated", F.expr(CONTAMINATED))


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slots: int = SLOTS, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    key = unused("key")
    hits = window_hits(docs, items, text_col, item_id_col, item_text_col, window, slots, bits).where(CONTAMINATED).select(F.col("key").alias(key))
    return lookup(docs.withColumn(key, text_key(text_col)), hits, [key], "left_anti").drop(key)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged against all benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )
