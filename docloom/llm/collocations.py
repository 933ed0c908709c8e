"""Phrase collocation mining by vertical positional inverted lists (operator 13).

Texts are dealt to blocks; a block holds, for each of its words, the list of
positions at which the word occurs. Positions rise by one from word to word and
leave a gap between pieces, so words are adjacent if their positions are.

1. The lengths of a word's lists over all blocks add up to its exact frequency;
   lists of words that are not frequent go.
2. A phrase is extended by merging its list with the postings of the adjacent
   word, which stand one position further: those with a frequent phrase of the
   same length there, as no frequent phrase has an infrequent part. Again the
   lengths add up, and lists of infrequent phrases go before the next level.
3. Only (block, phrase, length) rows are shuffled to be counted; the lists stay
   by block. A phrase has one such row a block, so the most frequent phrase
   of all is no larger in one place than the number of blocks.
4. Frequent phrases carry the frequencies of all their first and last parts, so
   scores need no further join.

Defined results: null text is empty, null lang is ``und``; each row is a
document, also one of a repeated id or text; an empty table gives no rows. A
block is cut between pieces only, so its size is BLOCK_BYTES or one piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docloom.llm.common import lookup, materialize, scratch, slices, table

#: Candidates have 2 to MAX_WORDS words and occur so often in their language.
MAX_WORDS, MIN_COUNT = 3, 10
#: Scores are whole numbers of this scale.
SCALE = 1_000_000
#: A candidate goes if a longer one has at least so many per cent of its frequency.
ABSORBED = 50
#: Phrases reported for each language.
TOP_PHRASES = 2_000
#: Bytes of text of one language in a block.
BLOCK_BYTES = 12 << 20
#: A task holds text of so many blocks at most, however many languages it meets.
HELD_BLOCKS = 4
#: Positions whose pairs are found at once, and pairs in one Arrow batch (more only if a single phrase has more).
PART = 1 << 17
#: Blocks in one file: a reader decodes the rows of a file together, and a writer keeps up to a hundred rows in memory.
BLOCKS_A_FILE = 4

BREAKS = b".,;:!?\n\x0b\x0c\r"
LOWER_AND_CUT = bytes(ord("\n") if b in BREAKS else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
TOKEN = re.compile(rb"[^ \n]+|\n")

#: Numbers that only Python reads are binary: Spark takes long to hand rows on in Arrow batches behind an array of millions.
WORD_LISTS = "lang string, block bigint, n bigint, words array<binary>, each array<int>, counts binary, deltas binary"
LISTS = "block bigint, ids binary, counts binary, deltas binary"
KEYS = "block bigint, i int, prefix bigint, suffix bigint, n bigint"
COUNTS = "prefix bigint, suffix bigint, n bigint"


def pack(positions: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ascending lists, one behind the other, as steps from place to place: most are small."""
    starts = np.cumsum(counts) - counts
    steps = np.diff(positions, prepend=positions.dtype.type(0))
    steps[starts] = positions[starts]
    return steps


def unpack(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions again. Sums of 32 bits may overflow on the way; positions have 31, so differences of sums are right."""
    starts = np.cumsum(counts) - counts
    sums = np.cumsum(steps, dtype=steps.dtype)
    return sums - np.repeat(sums[starts] - steps[starts], counts)


def _one(values: pa.Array) -> pa.Array:
    """An array column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _binary(values: np.ndarray, kind: type) -> pa.Array:
    """A binary column of one row: the first bytes of all numbers, then the second ones, as high bytes are alike and take little space."""
    planes = values.astype(kind).view(np.uint8).reshape(-1, kind().itemsize).T
    return pa.array([planes.tobytes()], pa.binary())


def _numbers(cell: pa.BinaryScalar, kind: type) -> np.ndarray:
    planes = np.frombuffer(cell.as_buffer(), np.uint8).reshape(kind().itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def coded_words(data: bytes, part: int = 1 << 20) -> pa.DictionaryArray:
    """The words and line ends of a block as numbers of distinct ones; only ``part`` bytes and the line they end in are Python objects at a time."""
    found, start = [], 0
    while start < len(data):
        end = data.find(b"\n", start + part) + 1 or len(data)
        found.append(pa.array(TOKEN.findall(data, start, end), pa.binary()).dictionary_encode())
        start = end
    return pa.chunked_array(found, pa.dictionary(pa.int32(), pa.binary())).unify_dictionaries().combine_chunks()


def _word_lists(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("words", pa.list_(pa.binary())), ("each", pa.list_(pa.int32())), ("counts", pa.binary()), ("deltas", pa.binary())])
    block = TaskContext.get().partitionId() << 32
    held: dict[str, bytearray] = {}
    size = 0

    def flush(lang: str, cut: int) -> Iterator[pa.RecordBatch]:
        nonlocal block, size
        data = bytes(memoryview(held[lang])[:cut])
        del held[lang][:cut]
        size -= cut
        if not data:
            return
        coded = coded_words(data)
        codes, words = coded.indices.to_numpy(), coded.dictionary
        gap = words.index(pa.scalar(b"\n", pa.binary())).as_py()
        order = np.argsort(codes, kind="stable").astype(np.int32)
        counts = np.bincount(codes, minlength=len(words))
        if gap >= 0:
            order = order[codes[order] != gap]
            counts = np.delete(counts, gap)
            words = pa.concat_arrays([words[:gap], words[gap + 1 :]])
        if len(words):
            values = [pa.array([lang], pa.string()), pa.array([block], pa.int64()), pa.array([len(order)], pa.int64()), _one(words), _one(pa.array(counts, pa.int32())), _binary(counts, np.int32), _binary(pack(order, counts), np.int32)]
            yield pa.RecordBatch.from_arrays(values, schema=schema)
            block += 1

    for whole in batches:
        for batch in slices(whole, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                data = held.setdefault(lang, bytearray())
                data += text.translate(LOWER_AND_CUT)
                data += b"\n"
                size += len(text) + 1
                while len(data) >= block_bytes:
                    yield from flush(lang, data.rfind(b"\n", 0, block_bytes) + 1 or data.index(b"\n") + 1)
                while size > HELD_BLOCKS * block_bytes:
                    largest = max(held, key=lambda x: len(held[x]))
                    yield from flush(largest, len(held[largest]))
                    del held[largest]
    for lang in list(held):
        yield from flush(lang, len(held[lang]))


def word_lists(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a block: its language, its number of words, its distinct words, and their lists of positions one behind the other."""
    plain = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(lambda batches: _word_lists(batches, block_bytes), WORD_LISTS)


def extended(counts: np.ndarray, steps: np.ndarray, part: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """prefix, suffix (places in the list of phrases), count and positions of each pair of listed phrases that stand one position apart.

    Both lists are merged by position: what stands at a place and what stands
    at the next one. Pairs are in a fixed order, so a later call finds them
    again, and come in parts: those of the phrases that have ``part`` positions
    together, or of one phrase.
    """
    at = unpack(steps, counts)
    placed = np.full(int(at.max()) + 2 if len(at) else 1, -1, np.int32)
    placed[at] = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    ends = np.cumsum(counts)
    phrase, start = 0, 0
    while phrase < len(counts):
        phrase = max(phrase + 1, int(np.searchsorted(ends, start + part, "right")))
        here = at[start : ends[phrase - 1]]
        start = int(ends[phrase - 1])
        here = here[placed[here + 1] >= 0]
        pair = placed[here].astype(np.int64) * len(counts) + placed[here + 1]
        order = np.argsort(pair, kind="stable")
        pair, here = pair[order], here[order]
        first = np.nonzero(np.diff(pair, prepend=-1))[0]
        yield pair[first] // len(counts), pair[first] % len(counts), np.diff(first, append=len(pair)), here


def key_batches(block: int, ids: np.ndarray, counts: np.ndarray, steps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """KEYS of the pairs of a block's lists, some at a time: what Spark and Python exchange is held several times over."""
    i = 0
    for prefix, suffix, n, _ in extended(counts, steps):
        numbers = np.arange(i, i + len(n))
        i += len(n)
        values = [pa.array(np.full(len(n), block), pa.int64()), pa.array(numbers, pa.int32()), pa.array(ids[prefix], pa.int64()), pa.array(ids[suffix], pa.int64()), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(values, names=["block", "i", "prefix", "suffix", "n"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield from key_batches(batch.column("block")[row].as_py(), *(_numbers(batch.column(c)[row], k) for c, k in (("ids", np.int64), ("counts", np.int32), ("deltas", np.int32))))


def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.StructScalar, np.ndarray, np.ndarray]]:
    """Each block of ``with_frequent``: its lists, and the numbers in the block and the ids of its frequent phrases."""
    held = None

    def whole() -> tuple[int, pa.StructScalar, np.ndarray, np.ndarray]:
        block, lists, numbers, ids = held
        return block, lists, np.concatenate(numbers), np.concatenate(ids)

    for batch in batches:
        i, ids = (batch.column(c).fill_null(-1).to_numpy() for c in ("i", "id"))
        bounds = [*np.nonzero(i < 0)[0].tolist(), len(i)]
        if held:
            held[2].append(i[: bounds[0]].copy())
            held[3].append(ids[: bounds[0]].copy())
        for start, stop in zip(bounds, bounds[1:], strict=False):
            if held:
                yield whole()
            held = batch.column("block")[start].as_py(), batch.column("lists")[start], [i[start + 1 : stop].copy()], [ids[start + 1 : stop].copy()]
    if held:
        yield whole()


def kept_lists(lists: pa.StructScalar, numbers: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, counts and steps of a block's frequent phrases; ``numbers`` ascend."""
    counts, steps = (_numbers(lists[c], np.int32) for c in ("counts", "deltas"))
    parts = ((n, at) for *_, n, at in extended(counts, steps)) if lists["longer"].as_py() else [(counts, unpack(steps, counts))]
    sizes, found, first = [], [], 0
    for n, at in parts:
        low, high = np.searchsorted(numbers, (first, first + len(n)))
        kept = np.zeros(len(n), bool)
        kept[numbers[low:high] - first] = True
        first += len(n)
        sizes.append(n[kept].astype(np.int32))
        found.append(pack(at[np.repeat(kept, n)], n[kept]))
    return ids, np.concatenate(sizes), np.concatenate(found)


def _frequent_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, lists, numbers, ids in followed(batches):
        if len(numbers):
            ids, counts, steps = kept_lists(lists, numbers, ids)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), _binary(ids, np.int64), _binary(counts, np.int32), _binary(steps, np.int32)], names=["block", "ids", "counts", "deltas"])


def _longer_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, lists, numbers, ids in followed(batches):
        if len(numbers):
            for batch in key_batches(block, *kept_lists(lists, numbers, ids)):
                yield batch.select(["prefix", "suffix", "n"])


def frequent_keys(keys: DataFrame, key: list[str], min_count: int) -> DataFrame:
    """``keys`` (one row a block and phrase) of the frequent phrases, with their frequency f, an id, and once in one row of each.

    The id is the number of one of the phrase's rows, hence no hash that two phrases could share.
    """
    same = Window.partitionBy(*key)
    numbered = keys.withColumn("row", F.monotonically_increasing_id())
    counted = numbered.withColumns({"f": F.sum("n").over(same), "id": F.min("row").over(same)}).where(F.col("f") >= min_count)
    return counted.withColumn("once", F.col("row") == F.col("id")).drop("row", "n")


def with_frequent(lists: DataFrame, frequent: DataFrame, longer: bool) -> DataFrame:
    """Each block's lists, followed by the rows of its frequent phrases: these are its listed phrases, or if ``longer`` pairs of them.

    A task reads these rows as a stream; a group would be sent to Python as one piece.
    """
    own = F.struct(F.lit(longer).alias("longer"), "counts", "deltas").alias("lists")
    heads = lists.select("block", F.lit(-1).alias("i"), F.lit(None).cast("bigint").alias("id"), own)
    rows = frequent.select("block", "i", "id", F.lit(None).cast(heads.schema["lists"].dataType).alias("lists"))
    return heads.unionByName(rows).repartition("block").sortWithinPartitions("block", "i")


def frequent_phrases(docs: DataFrame, max_words: int, min_count: int, stored: Callable[..., DataFrame], block_bytes: int = BLOCK_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """For each length up to ``max_words`` a table of phrases, and the number of words of each language.

    A phrase has lang, id, f, its words' ids, heads (frequencies of its first
    1, 2, ... words) and tails (of its last 1, 2, ...); single words have their
    word, longer phrases the ids prefix and suffix of what they are without
    their last and first word. Lists and keys are tables of their own, which go
    as soon as those of the next level are written; what is returned is
    ``stored``. Lists of the length before the last are counted as they are
    made, and never written.
    """
    with ExitStack() as every:

        def tables() -> tuple[ExitStack, Callable[..., DataFrame]]:
            own = every.enter_context(ExitStack())
            return own, own.enter_context(scratch(docs.sparkSession))

        past, kept = tables()
        blocks = kept(word_lists(docs, block_bytes), BLOCKS_A_FILE)
        sizes = stored(blocks.groupBy("lang").agg(F.sum("n").alias("n")))
        words = frequent_keys(blocks.select("lang", "block", F.posexplode(F.arrays_zip("words", "each")).alias("i", "x")).select("lang", "block", "i", F.col("x.words").alias("word"), F.col("x.each").alias("n")), ["lang", "word"], min_count)
        found = kept(words)
        none = F.array().cast("array<bigint>")
        levels = [stored(found.where("once").select("lang", "id", "f", F.col("word").cast("string").alias("word"), F.array("id").alias("ids"), none.alias("heads"), none.alias("tails")))]
        now, kept = tables()
        lists = kept(with_frequent(blocks, found, False).mapInArrow(_frequent_lists, LISTS), BLOCKS_A_FILE)
        past.close()
        keys = lists.mapInArrow(_keys, KEYS)
        for length in range(2, max_words + 1):
            if length < max_words:
                past, (now, kept) = now, tables()
                found = kept(frequent_keys(keys, ["prefix", "suffix"], min_count))
                phrases = found.where("once").select("prefix", "suffix", "id", "f")
                pairs = with_frequent(lists, found, True)
                if length + 1 < max_words:
                    lists = kept(pairs.mapInArrow(_frequent_lists, LISTS), BLOCKS_A_FILE)
                    keys = lists.mapInArrow(_keys, KEYS)
                    past.close()
                else:
                    keys = pairs.mapInArrow(_longer_counts, COUNTS)
            else:
                # a pair has one row a block: adding up before the rows are dealt would hold all in memory and join hardly any
                counted = keys.repartition("prefix", "suffix").groupBy("prefix", "suffix").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
                phrases = stored(counted.withColumn("id", F.monotonically_increasing_id()))
                every.close()
            head = levels[-1].select(F.col("id").alias("prefix"), F.col("ids").alias("first"), F.concat("heads", F.array("f")).alias("heads"))
            tail = levels[-1].select(F.col("id").alias("suffix"), "lang", F.element_at("ids", -1).alias("last"), F.concat("tails", F.array("f")).alias("tails"))
            joined = lookup(lookup(phrases, head, ["prefix"], salts=1), tail, ["suffix"], salts=1)
            levels.append(stored(joined.select("lang", "id", "f", "prefix", "suffix", F.concat("first", F.array("last")).alias("ids"), "heads", "tails")))
        return levels, sizes


def with_score(phrases: DataFrame) -> DataFrame:
    """``phrases`` with a, l, r and score of the cut with the lowest score, the first of those that tie."""
    at = "CAST({} AS DECIMAL({},0))"
    l, r = "heads[k - 1]", "tails[size(ids) - k - 1]"
    square = f"{at.format(SCALE, 7)} * {at.format('f', 15)} * {at.format('f', 15)}"
    scores = f"transform(sequence(1, size(ids) - 1), k -> ({square}) div ({at.format(l, 18)} * {at.format(r, 18)}))"
    cut = phrases.withColumn("scores", F.expr(scores)).withColumn("score", F.array_min("scores")).withColumn("k", F.expr("CAST(array_position(scores, score) AS INT)"))
    return cut.withColumns({"a": F.col("f"), "l": F.expr(l), "r": F.expr(r)}).drop("scores", "k")


def not_absorbed(phrases: DataFrame, longer: DataFrame | None, share: int) -> DataFrame:
    """``phrases`` without those that a longer candidate holds with ``share`` per cent of their frequency; one word longer suffices, as still longer ones are no more frequent."""
    if longer is None:
        return phrases
    inside = longer.select(F.explode(F.array("prefix", "suffix")).alias("id"), F.col("f").alias("longest")).groupBy("id").agg(F.max("longest").alias("longest"))
    return phrases.join(inside.hint("merge"), "id", "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("f"))).drop("longest")


def mine_collocations(docs: DataFrame, top: int = TOP_PHRASES, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, share: int = ABSORBED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language of ``docs`` (lang, text)."""
    with scratch(docs.sparkSession) as stored:
        levels, sizes = frequent_phrases(docs, max_words, min_count, stored, block_bytes)
        kept = None
        for i, phrases in enumerate(levels[1:], 1):
            left = with_score(not_absorbed(phrases, levels[i + 1] if i + 1 < len(levels) else None, share)).select("lang", "ids", "a", "l", "r", "score")
            kept = left if kept is None else kept.unionByName(left)
        level = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
        best = stored(kept.withColumn("level", F.rank().over(level)).where(F.col("level") <= top).drop("level").withColumn("row", F.monotonically_increasing_id()))
        words = levels[0].select("id", "word")
        spelled = best.select("row", F.posexplode("ids").alias("at", "id")).join(words, "id").groupBy("row").agg(F.collect_list(F.struct("at", "word")).alias("words"))
        phrase = F.array_join(F.transform(F.array_sort("words"), lambda w: w["word"]), " ")
        named = best.join(spelled.select("row", phrase.alias("phrase")), "row").join(sizes, "lang")
        order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return materialize(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of every language of ``documents``."""
    return mine_collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, w[i] AS first, w[i + m - 1] AS last, w[i + 1] AS second, count(*) AS f
      FROM i, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
f AS (SELECT lang, m, phrase, any_value(first) AS first, any_value(last) AS last, any_value(second) AS second, sum(f) AS f FROM g GROUP BY lang, m, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND f >= {MIN_COUNT}),
k AS (SELECT c.lang, c.m, c.phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r FROM c JOIN f l ON l.lang = c.lang AND l.m = 1 AND l.phrase = c.first
        JOIN f r ON r.lang = c.lang AND r.m = c.m - 1 AND r.phrase = CASE WHEN c.m = 2 THEN c.last ELSE c.second || ' ' || c.last END
      UNION ALL SELECT c.lang, c.m, c.phrase, c.f, 2, l.f, r.f FROM c JOIN f l ON l.lang = c.lang AND l.m = 2 AND l.phrase = c.first || ' ' || c.second
        JOIN f r ON r.lang = c.lang AND r.m = 1 AND r.phrase = c.last WHERE c.m = 3),
s AS (SELECT *, {SCALE}::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM k),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, first || ' ' || second AS phrase, f FROM c WHERE m = 3 UNION ALL SELECT lang, second || ' ' || last, f FROM c WHERE m = 3),
gone AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN inside x ON x.lang = b.lang AND x.phrase = b.phrase WHERE b.m = 2 AND 100 * x.f >= {ABSORBED} * b.a),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank FROM b ANTI JOIN gone USING (lang, phrase))
SELECT o.lang, o.rank, o.phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= {TOP_PHRASES}
"""
