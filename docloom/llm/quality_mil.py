"""Quality classifier: gated-attention multiple-instance learning (operator 10).

A document is a bag of passages of 48 words. Each passage is encoded from its
own content alone: hashed character trigrams, kinds of characters and word
shapes. A gated attention layer, learned from document labels alone, weighs the
passages, and the weighted representation is scored. Whole texts are encoded
and scored; only the labelled rows used for fitting are a bounded sample
(MAX_TRAIN documents of at most MAX_TRAIN_BYTES bytes, one text for each id).

Defined results: null and empty texts are a bag of one empty passage and get
its score; conflicting labels of one id count by their mean; rows without a
label or an id are never learned from; without labels of both kinds the score
is the share of good labels (0.5 if there is none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docloom.llm.common import append_columns, table

PASSAGE_WORDS = 48
MAX_TRAIN = 4_000
MAX_TRAIN_BYTES = 1 << 14
#: Buckets of hashed trigrams, and the bytes of text that are hashed at once.
GRAMS, CHUNK = 128, 1 << 20
HIDDEN, ATTENTION = 16, 8
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-4

#: Kinds of bytes that a passage's shape is measured by.
KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:", "!", "?", "*", "#", "$", "%", "&", "|", "<>", "()[]{}", "\"'`", "-_/\\=+~^@"]
OTHER, LEAD, TRAIL = len(KINDS), len(KINDS) + 1, len(KINDS) + 2
N_KINDS = len(KINDS) + 3
N_FEATURES = N_KINDS + GRAMS + 4
KIND = np.full(256, OTHER, np.int64)
for _k, _chars in enumerate(KINDS):
    KIND[list(_chars.encode())] = _k
KIND[0x80:0xC0], KIND[0xC0:] = TRAIL, LEAD
BLANKS = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def passages(text: bytes | None, size: int = PASSAGE_WORDS) -> np.ndarray:
    """One row of N_FEATURES numbers for each passage; one row of zeros for a text without words."""
    words = text.split() if text else []
    if not words:
        return np.zeros((1, N_FEATURES), np.float32)
    n = -(-len(words) // size)
    raw = np.frombuffer(text.lower(), np.uint8)
    blank = BLANKS[raw]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))[::size]
    held = np.full(n, size, np.float32)
    held[-1] = len(words) - size * (n - 1)
    lengths = np.fromiter(map(len, words), np.float32, len(words))
    at = np.arange(0, len(words), size)
    mean = np.add.reduceat(lengths, at) / held
    spread = np.sqrt(np.maximum(np.add.reduceat(lengths**2, at) / held - mean**2, 0))
    distinct = np.fromiter((len(set(words[i : i + size])) for i in at), np.float32, n) / held
    kinds, grams = np.zeros(n * N_KINDS, np.float32), np.zeros(n * GRAMS, np.float32)
    cased = KIND[np.frombuffer(text, np.uint8)]
    for begin in range(0, len(raw), CHUNK):
        end = min(begin + CHUNK, len(raw))
        of = np.maximum(np.searchsorted(starts, np.arange(begin, end), "right") - 1, 0)
        first, last = of[0], of[-1] + 1
        kinds[first * N_KINDS : last * N_KINDS] += np.bincount((of - first) * N_KINDS + cased[begin:end], minlength=(last - first) * N_KINDS)
        part = raw[begin : end + 2].astype(np.uint32)
        hashes = ((part[:-2] | part[1:-1] << 8 | part[2:] << 16) * np.uint32(2654435761)) >> np.uint32(32 - GRAMS.bit_length() + 1)
        grams[first * GRAMS : last * GRAMS] += np.bincount((of[: len(hashes)] - first) * GRAMS + hashes, minlength=(last - first) * GRAMS)
    kinds, grams = kinds.reshape(n, N_KINDS), grams.reshape(n, GRAMS)
    kinds[:, TRAIL] = 0
    out = np.empty((n, N_FEATURES), np.float32)
    out[:, :N_KINDS] = np.sqrt(kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1))
    out[:, N_KINDS : N_KINDS + GRAMS] = np.sqrt(grams / np.maximum(grams.sum(axis=1, keepdims=True), 1))
    out[:, N_KINDS + GRAMS :] = np.stack([np.log1p(mean), np.log1p(spread), distinct, np.log1p(held) / 4], axis=1)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits of the bags that begin at ``starts``, and what the backward pass needs."""
        w = self.weights
        h = np.maximum(x @ w["encode"] + w["shift"], 0)
        t, g = np.tanh(h @ w["tanh"]), sigmoid(h @ w["gate"])
        e = (t * g) @ w["attend"]
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return z @ w["out"] + w["bias"][0], (h, t, g, a, z, sizes)

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Those of the mean log loss of bags."""
        w = self.weights
        logit, (h, t, g, a, z, sizes) = self.forward(x, starts)
        d = (sigmoid(logit) - y) / len(y)
        grad = {"out": z.T @ d, "bias": np.array([d.sum()])}
        dz = np.repeat(d[:, None] * w["out"], sizes, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        grad["attend"] = (t * g).T @ de
        dtg = de[:, None] * w["attend"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        grad["tanh"], grad["gate"] = h.T @ dt, h.T @ dg
        dh = (a[:, None] * dz + dt @ w["tanh"].T + dg @ w["gate"].T) * (h > 0)
        grad["encode"], grad["shift"] = x.T @ dh, dh.sum(axis=0)
        return grad

    def attention(self, bag: np.ndarray) -> np.ndarray:
        """The weight of each passage of one bag."""
        return self.forward((bag - self.mean) / self.scale, np.array([0]))[1][3]

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """The chance of label 1 of each bag of passages."""
        x = (np.concatenate(bags) - self.mean) / self.scale
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        return sigmoid(self.forward(x, starts)[0])


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> AttentionModel | None:
    """Learn encoder, gated attention and output by Adam on the log loss of whole bags; None without both labels."""
    if len(set((y >= 0.5).tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    scale = every.std(axis=0)
    model = AttentionModel(every.mean(axis=0), np.where(scale > 1e-6, scale, 1).astype(np.float32), {})
    shapes = {"encode": (N_FEATURES, HIDDEN), "shift": (HIDDEN,), "tanh": (HIDDEN, ATTENTION), "gate": (HIDDEN, ATTENTION), "attend": (ATTENTION,), "out": (HIDDEN,), "bias": (1,)}
    w = model.weights = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("shift", "bias") else np.zeros(s)).astype(np.float64) for k, s in shapes.items()}
    w["bias"][0] = np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    bags = [(b - model.mean) / model.scale for b in bags]
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in chosen])
            starts = np.cumsum([0] + [len(bags[i]) for i in chosen[:-1]])
            grad = model.gradients(x, starts, y[chosen])
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for k, v in w.items():
                update = grad[k] + DECAY * v
                first[k] = 0.9 * first[k] + 0.1 * update
                second[k] = 0.999 * second[k] + 0.001 * update**2
                v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def mean_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id and y, the mean label, of ids with a label."""
    return labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.avg("y").alias("y"))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, use: Column, limit: int, max_bytes: int) -> DataFrame:
    """id, text and y of at most ``limit`` labelled documents, taken in the order of a hash of their ids; one text of at most ``max_bytes`` for each."""
    chosen = mean_labels(labels, id_col, label_col).where(use).orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.octet_length("text") <= max_bytes)
    both = texts.join(F.broadcast(chosen), "id")  # at most ``limit`` ids
    return both.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", use: Column | None = None, limit: int = MAX_TRAIN) -> AttentionModel | float:
    """Fit on a bounded sample of the labelled rows that ``use``, a condition on ``id``, admits."""

    def make():
        return lambda texts: [[passages(t).astype(np.float16).tobytes() for t in texts]]

    sample = training_sample(docs, labels, id_col, text_col, label_col, F.lit(True) if use is None else use, limit, MAX_TRAIN_BYTES)
    rows = append_columns(sample, "text", [T.StructField("bag", T.BinaryType())], make, binary=True, drop=("text",)).collect()
    rows.sort(key=lambda r: r["id"])
    y = np.array([r["y"] for r in rows])
    model = fit([np.frombuffer(r["bag"], np.float16).astype(np.float32).reshape(-1, N_FEATURES) for r in rows], y) if rows else None
    return (float(y.mean()) if rows else 0.5) if model is None else model


def score_quality(docs: DataFrame, model: AttentionModel | float, text_col: str = "text", keep_text: bool = True, score_col: str = "score") -> DataFrame:
    """``docs`` with a score, the chance of label 1, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kB

    def make():
        fitted = shared.value
        if isinstance(fitted, float):
            return lambda texts: [[fitted] * len(texts)]
        return lambda texts: [fitted.score([passages(t) for t in texts]).tolist()]

    return append_columns(docs, text_col, [T.StructField(score_col, T.DoubleType())], make, binary=True, drop=() if keep_text else (text_col,))


def fold(column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(column.cast("string").cast("binary")) % folds


def op10_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a model that has not seen the held-out labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), use=fold(F.col("id"), 3) != 1)
    scored = score_quality(docs, model, keep_text=False)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
