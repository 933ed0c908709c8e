"""Toxicity by maximum-scoring segments of token log-odds (operator 3).

* Token log-odds compare the share of toxic documents among those that hold a
  token with the share among all, under Dirichlet priors: a token's prior is
  that of its six-letter prefix, whose prior is that of its four-letter prefix,
  so that inflected and unseen words are scored too.
* Less a drift, they make a negative-drift walk over the text. A linear-time
  scan finds every maximal-scoring segment.
* A text of n tokens without toxic passages has maxima that follow an
  extreme-value law with K * n * exp(-lambda * S) expected segments of score S.
  lambda and K are fitted on clean labelled documents; a segment is significant
  if fewer than one is expected, and counts by how far it exceeds that.
* The sum over all significant segments is calibrated to a probability.

Whole texts are scored; only the labelled rows used for fitting are a bounded
sample (MAX_TRAIN documents of at most MAX_TRAIN_BYTES bytes, MAX_TOKENS tokens).
A quarter of the sample is kept from the counts and calibrates them.

Defined results: null and empty texts have no tokens and get the score of a
text without segments; rows without a label or an id are never learned from;
without labels of both kinds the score is the share of toxic labels (or 0).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docloom.llm.common import append_columns, slices, table
from docloom.llm.quality_mil import fold, training_sample

MAX_TRAIN, MAX_TRAIN_BYTES = 12_000, 1 << 15
#: Tokens and prefixes of the sample that are kept, the most frequent first; they are sent to every task.
MAX_TOKENS = 400_000
CALIBRATE = 4
PREFIXES = (4, 6)
PRIOR_WORD, PRIOR_PREFIX = 5.0, 10.0
#: Scores are cut to this range before the drift is taken off.
LOW, HIGH, DRIFT = -1.0, 6.0, 0.6
CACHE_ENTRIES = 400_000
#: ASCII bytes other than letters end a token.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(LETTERS).split() if text else []


def prefixes(token: bytes) -> list[bytes]:
    """Marked prefixes of a token, shortest first."""
    return [b"^" + token[:k] for k in PREFIXES if len(token) > k]


class TokenScores(dict):
    """token -> its log-odds less the drift; fills itself, within a bound."""

    def __init__(self, counts: dict[bytes, tuple[int, int]], base: float):
        super().__init__()
        self.counts, self.base = counts, base

    def __missing__(self, token: bytes) -> float:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        share = self.base
        for part in prefixes(token):
            toxic, total = self.counts.get(part, (0, 0))
            share = (toxic + PRIOR_PREFIX * share) / (total + PRIOR_PREFIX)
        toxic, total = self.counts.get(token, (0, 0))
        share = (toxic + PRIOR_WORD * share) / (total + PRIOR_WORD)
        odds = math.log(share / (1 - share)) - math.log(self.base / (1 - self.base))
        score = self[token] = min(max(odds, LOW), HIGH) - DRIFT
        return score


def scored_walk(scores: TokenScores, text: str | None) -> list[float]:
    """The scores of a text's tokens; a token that repeats the one before it brings no new evidence."""
    found = tokens(text)
    out = list(map(scores.__getitem__, found))
    if len(set(found)) < len(found):
        for at, (one, two) in enumerate(zip(found, found[1:])):
            if one == two:
                out[at + 1] = -DRIFT
    return out


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment (start, end, score), in one pass over the scores."""
    found: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    total = 0.0
    for at, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start, left = at, before
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= left:
                k -= 1
            if k < 0 or found[k][3] >= total:
                break
            start, left = found[k][0], found[k][2]
            del found[k:]
        found.append((start, at + 1, left, total))
    return [(start, end, after - left) for start, end, left, after in found]


@dataclass
class ToxicityModel:
    counts: dict[bytes, tuple[int, int]]
    base: float
    rate: float = 1.0  # lambda
    k: float = 0.1
    calibration: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def excess(self, score: float, n: int) -> float:
        """How far a segment's score lies above the one that is expected once in n tokens."""
        return self.rate * score - math.log(self.k * n)

    def probability(self, evidence: float, n: int) -> float:
        a, b, c = self.calibration
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * math.log1p(evidence) + b * math.log1p(n) + c))))


def document_frequencies(sample: DataFrame) -> DataFrame:
    """token, toxic, total: documents of the sample that hold each token or prefix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        toxic: Counter[bytes] = Counter()
        for whole in batches:
            for batch in slices(whole, "text"):
                for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    held = set(tokens(text))
                    held.update(p for t in tuple(held) for p in prefixes(t))
                    total.update(held)
                    if y >= 0.5:
                        toxic.update(held)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array([toxic[t] for t in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["token", "toxic", "total"])

    return sample.select("text", "y").mapInArrow(count, "token binary, toxic bigint, total bigint").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))


def walk_statistics(sample: DataFrame, counts: dict, base: float) -> list[tuple[float, int, list[float], list[float]]]:
    """(label, tokens, segment scores, histogram of token scores in tenths) of each document of the sample."""
    shared = sample.sparkSession.sparkContext.broadcast((counts, base))
    bins = np.arange(LOW - DRIFT, HIGH - DRIFT + 0.2, 0.1)

    def make():
        scores = TokenScores(*shared.value)

        def work(texts):
            out: list[list] = [[], [], []]
            for text in texts:
                walk = scored_walk(scores, text)
                out[0].append(len(walk))
                out[1].append([s for _, _, s in maximal_segments(walk)])
                out[2].append(np.histogram(walk, bins)[0].astype(float).tolist())
            return out

        return work

    fields = [T.StructField("n", T.LongType()), T.StructField("segments", T.ArrayType(T.DoubleType())), T.StructField("bins", T.ArrayType(T.DoubleType()))]
    rows = append_columns(sample.select("y", "text"), "text", fields, make, drop=("text",)).collect()  # at most MAX_TRAIN / CALIBRATE rows or so
    return sorted((r["y"], r["n"], r["segments"], r["bins"]) for r in rows)


def fit_rate(histogram: np.ndarray) -> float:
    """The positive lambda for which clean token scores have mean exp(lambda * score) = 1."""
    centres = np.arange(len(histogram)) * 0.1 + LOW - DRIFT + 0.05
    share = histogram / max(histogram.sum(), 1)
    low, high = 1e-3, 5.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(middle * centres)).sum() < 1 else (low, middle)
    return low


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, ...]:
    """Newton's method with a little ridge, for a handful of features."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
    return tuple(map(float, w))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", use: Column | None = None, limit: int = MAX_TRAIN) -> ToxicityModel | float:
    """Fit on a bounded sample of the labelled rows that ``use``, a condition on ``id``, admits."""
    sample = training_sample(docs, labels, id_col, text_col, label_col, F.lit(True) if use is None else use, limit, MAX_TRAIN_BYTES).cache()
    kinds = sample.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("y") >= 0.5).cast("double")), F.lit(0.0)).alias("p")).first()
    if not 0 < kinds["p"] < 1:
        sample.unpersist()
        return float(kinds["p"])
    base = kinds["p"]
    part = F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(CALIBRATE))
    rows = document_frequencies(sample.where(part > 0)).where("total > 1").orderBy(F.desc("total"), "token").limit(MAX_TOKENS).collect()
    counts = {bytes(r["token"]): (r["toxic"], r["total"]) for r in rows}
    walks = walk_statistics(sample.where(part == 0), counts, base)
    sample.unpersist()
    model = ToxicityModel(counts, base)
    clean = [w for w in walks if w[0] < 0.5 and w[1]]
    if clean:
        model.rate = fit_rate(np.sum([w[3] for w in clean], axis=0))
        model.k = len(clean) / max(sum(n * math.exp(-model.rate * max(s, default=0.0)) for _, n, s, _ in clean), 1e-9)
    x = np.array([[math.log1p(sum(max(0.0, model.excess(s, n)) for s in segments)), math.log1p(n), 1.0] for _, n, segments, _ in walks])
    if len(walks):
        model.calibration = fit_logistic(x, np.array([float(w[0] >= 0.5) for w in walks]))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | float, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with score (the chance of label 1) and passages: start and end token and score of every significant toxic passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_TOKENS tokens
    passage = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    fields = [T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))]

    def make():
        fitted = shared.value
        if isinstance(fitted, float):
            return lambda texts: [[fitted] * len(texts), [[] for _ in texts]]
        scores = TokenScores(fitted.counts, fitted.base)

        def work(texts):
            out: list[list] = [[], []]
            for text in texts:
                walk = scored_walk(scores, text)
                n = len(walk)
                found = [(a, b, s) for a, b, s in maximal_segments(walk) if fitted.excess(s, n) > 0] if n else []
                out[0].append(fitted.probability(sum(fitted.excess(s, n) for _, _, s in found), n))
                out[1].append([{"start": a, "end": b, "score": s} for a, b, s in found])
            return out

        return work

    return append_columns(docs, text_col, fields, make, drop=() if keep_text else (text_col,))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model that has not seen the held-out labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), use=fold(F.col("id"), 4) != 2)
    scored = score_toxicity(docs, model, keep_text=False)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
