"""Filtered vector search over an approximation file, its benchmark, and the hashing embedder."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docloom.operators.retrieval import DENSE_CELLS, MAX_STEP, cosine, dense_topk, top, unit
from docloom.operators.stored import stored

#: Bits of one dimension in a code, and candidates whose vectors the first round reads, as a multiple of k.
CODE_BITS, FIRST_ROUND = 4, 2
#: Rounding of what is compared.
SLACK = 2e-6
WIDTH = 1024
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def encode(vectors: DataFrame) -> DataFrame:
    """``vectors`` (chunk_id, scope, embedding) as codes: an eighth of the bytes of 32-bit vectors.

    ``code`` holds the unit vector's dimensions in CODE_BITS each, ``scale``
    what one step is worth, and ``error`` the distance between the vector and
    its code, by which no inner product with a unit vector can be further off.
    """
    levels = 2 ** (CODE_BITS - 1) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit(batch.column("embedding").to_pylist())
            scale = np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1e-12) / levels
            steps = np.rint(rows / scale)
            error = np.linalg.norm(rows - steps * scale, axis=1)
            nibbles = np.pad((steps + levels).astype(np.uint8), ((0, 0), (0, rows.shape[1] % 2)), constant_values=levels)
            packed = nibbles[:, ::2] << 4 | nibbles[:, 1::2]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("scope"), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(scale[:, 0]), pa.array(error)], names=["chunk_id", "scope", "code", "scale", "error"])

    return vectors.select("chunk_id", "scope", "embedding").mapInArrow(run, "chunk_id bigint, scope bigint, code binary, scale double, error double")


def candidates(codes: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """question, chunk_id, upper, place, next: what may be among the k nearest of a question's scope, by upper bound.

    A row stays if its upper bound reaches the kth largest lower bound: first of
    what a task has seen, then of all. ``next`` is the upper bound of the place
    after it. ``questions`` are at most BLOCK rows, which every task holds.
    """
    held = questions.select("question", "scope", "embedding").toPandas()
    names, matrix = held["question"].to_numpy(dtype=np.int64), unit(list(held["embedding"]))
    scopes = {scope: np.array(rows) for scope, rows in held.groupby("scope").indices.items()}
    shared = codes.sparkSession.sparkContext.broadcast((names, scopes, matrix))
    levels = 2 ** (CODE_BITS - 1) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scopes, matrix = shared.value
        lows = {scope: np.full((k, len(asked)), -np.inf) for scope, asked in scopes.items()}
        step = max(1, min(MAX_STEP, DENSE_CELLS // max(len(names), 1)))
        for whole in batches:
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                ids, where = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk_id", "scope"))
                packed = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                steps = np.stack([packed >> 4, packed & 15], axis=2).reshape(batch.num_rows, -1)[:, : matrix.shape[1]].astype(np.float64) - levels
                scale, error = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("scale", "error"))
                for scope, asked in scopes.items():
                    own = np.nonzero(where == scope)[0]
                    if not len(own):
                        continue
                    about = (steps[own] @ matrix[asked].T) * scale[own, None]
                    low, high = about - error[own, None] - SLACK, about + error[own, None] + SLACK
                    lows[scope] = np.partition(np.concatenate([lows[scope], low]), -k, axis=0)[-k:]
                    i, q = np.nonzero(high >= lows[scope][0])
                    yield pa.RecordBatch.from_arrays([pa.array(names[asked[q]]), pa.array(ids[own[i]]), pa.array(low[i, q]), pa.array(high[i, q])], names=["question", "chunk_id", "lower", "upper"])

    found = codes.mapInArrow(run, "question bigint, chunk_id bigint, lower double, upper double")
    kth = Window.partitionBy("question").orderBy(F.desc("lower"), "chunk_id")
    floor = F.min(F.when(F.col("by_lower") <= k, F.col("lower"))).over(Window.partitionBy("question"))
    left = found.withColumn("by_lower", F.row_number().over(kth)).withColumn("floor", floor).where(F.col("upper") >= F.col("floor"))
    order = Window.partitionBy("question").orderBy(F.desc("upper"), "chunk_id")
    return left.select("question", "chunk_id", "upper", F.row_number().over(order).alias("place"), F.lead("upper").over(order).alias("next"))


def filtered_search(codes: DataFrame, vectors: DataFrame, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k nearest vectors of each question's scope, and what was read for them.

    Codes of the scope are scanned; of the vectors only those of the best
    candidates are read, in rounds that double, until a question's kth score
    is above the bound of all that it has not read. So the filter never leaves
    a question short, and the result is exact. Returns (question, chunk_id,
    score, rank) and (question, read, rounds).
    """
    left = stored(candidates(codes, questions, k))
    asked = questions.select("question", F.col("embedding").alias("asked"))
    low, high, scored = 0, FIRST_ROUND * k, None
    open_ = left.select("question").distinct()
    number = 0
    while not open_.isEmpty():
        number += 1
        part = left.where((F.col("place") > low) & (F.col("place") <= high)).join(open_, "question", "left_semi")
        read = part.join(vectors.select("chunk_id", "embedding"), "chunk_id").join(asked, "question")
        seen = stored(read.select("question", "chunk_id", F.lit(number).alias("round"), "place", "next", F.round(F.coalesce(cosine(F.col("embedding"), F.col("asked")), F.lit(0.0)), 6).alias("score")))
        scored = seen if scored is None else scored.unionByName(seen)
        best = top(scored, k).groupBy("question").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        beyond = scored.groupBy("question").agg(F.max_by("next", "place").alias("next"))
        again = beyond.join(best, "question").where(F.col("next").isNotNull() & ((F.col("n") < k) | (F.col("kth") < F.col("next"))))
        open_ = stored(again.select("question"))
        low, high = high, 2 * high
    work = scored.groupBy("question").agg(F.count("*").alias("read"), F.max("round").alias("rounds"))
    return top(scored.select("question", "chunk_id", "score"), k), work


def benchmark(vectors: DataFrame, questions: DataFrame, k: int = 10, shares: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """selectivity, questions, expected, returned, hits, misplaced, codes, read, vectors_all of filters that one vector in ``shares`` passes.

    ``hits`` counts rows of the exact result, ``misplaced`` rows with a score
    above that of the row before, ``codes`` the codes that were compared and
    ``read`` the vectors that were read, over all questions.
    """
    out = None
    for share in shares:
        own = vectors.select("chunk_id", (F.col("chunk_id") % share).alias("scope"), "embedding")
        ask = questions.select("question", (F.floor(F.col("question") / 100) % share).alias("scope"), "embedding")
        codes = stored(encode(own))
        found, work = filtered_search(codes, own, ask, k)
        found = stored(found)
        exact = stored(dense_topk(own, ask, k)).select("question", "chunk_id", F.lit(1).alias("true"))
        before = F.lag("score").over(Window.partitionBy("question").orderBy("rank"))
        marked = found.withColumn("misplaced", (F.col("score") > before).cast("int")).join(exact, ["question", "chunk_id"], "full")
        counts = marked.agg(F.countDistinct("question").alias("questions"), F.count("true").alias("expected"), F.count("rank").alias("returned"), F.count_if(F.col("true").isNotNull() & F.col("rank").isNotNull()).alias("hits"), F.coalesce(F.sum("misplaced"), F.lit(0)).alias("misplaced"))
        compared = ask.groupBy("scope").agg(F.count("*").alias("q")).join(codes.groupBy("scope").agg(F.count("*").alias("n")), "scope").agg(F.sum(F.col("q") * F.col("n")).alias("codes"))
        row = counts.join(F.broadcast(compared)).join(F.broadcast(work.agg(F.sum("read").alias("read"), F.max("rounds").alias("rounds")))).join(F.broadcast(own.agg(F.count("*").alias("vectors"))))  # one row each
        row = stored(row.select(F.lit(1 / share).alias("selectivity"), *row.columns))
        out = row if out is None else out.unionByName(row)
    return out


def hash_embedding(text: str | None, width: int = WIDTH) -> list[float]:
    """Signed counts of lower-cased words in FNV-1a buckets, scaled to length one."""
    out = np.zeros(width)
    for word in re.findall(r"[^\W_]+", (text or "").lower()):
        h = FNV_OFFSET
        for byte in word.encode():
            h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
        out[h % width] += -1.0 if h >> 63 else 1.0
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).tolist()


def hash_embeddings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and the hashing embedding of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([hash_embedding(t) for t in batch.column(text).to_pylist()], pa.list_(pa.float64()))], names=[key, "embedding"])

    return docs.select(key, text).mapInArrow(run, f"{key} bigint, embedding array<double>")
