"""Quality classifier: similarity-weighted voting of the nearest labelled documents.

A text is a bag of hashed words and of pairs of neighbouring word shapes (short, long, capitals, digits,
marks, the same word again), weighted by frequency and rarity. A truncated singular value decomposition
of the labelled sample gives a latent space. The labelled vectors and the projection are broadcast; their
size follows from the parameters, not from the data. Each document is projected and compared exactly, in
blocks, with all of them.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS = re.compile(r"\w+|[^\w\s]+")
#: Shapes of words; the first buckets are those of pairs of shapes, once for equal and once for other words.
SHAPES = 16
PAIRS = 2 * SHAPES * SHAPES


@dataclass(frozen=True)
class Settings:
    """sample_rows bounds the labelled rows that are fitted; all others are parameters of the model."""

    sample_rows: int = 4096
    buckets: int = 8192
    dimensions: int = 64
    neighbours: int = 24
    threshold: float = 0.3
    seed: int = 7


def shape(token: str) -> int:
    """One of SHAPES classes of words and marks."""
    if token[0].isalpha():
        if token.islower():
            return (len(token) > 3) + (len(token) > 8)
        if token.isupper():
            return 3 if len(token) > 1 else 4
        return 5 if token[0].isupper() and token[1:].islower() else 6
    if token[0].isalnum() or token[0] == "_":
        return 7 if token.isdigit() else 8
    mark = ".,!?|".find(token[0])
    return 9 + mark if mark >= 0 and len(token) == 1 else 14 if len(token) == 1 else 15


class _Words(dict):
    """Token to its shape, bucket and a number of its own, as one integer; remembered for the frequent ones."""

    def __init__(self, n: int, most: int = 300_000):
        self.n, self.most, self.given = n, most, 0

    def __missing__(self, token: str) -> int:
        self.given += 1
        bucket = PAIRS + zlib.crc32(token.lower().encode("utf-8", "replace")) % (self.n - PAIRS)
        got = (self.given * self.n + bucket) * SHAPES + shape(token)
        if len(self) >= self.most:
            self.clear()
        self[token] = got
        return got


def bag(text: str | None, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their damped counts; none for a text without characters."""
    tokens = TOKENS.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    if len(words) + len(tokens) > words.most:  # one text's words get their numbers in one go
        words.clear()
    found = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    form, bucket = found % SHAPES, found // SHAPES % words.n
    pairs = form[:-1] * SHAPES + form[1:] + SHAPES * SHAPES * (found[1:] == found[:-1])
    counts = np.bincount(np.concatenate([pairs, bucket]))
    keys = np.flatnonzero(counts)
    return keys.astype(np.int32), (1 + np.log(counts[keys])).astype(np.float32)


@dataclass
class Model:
    settings: Settings
    rarity: np.ndarray  # of each bucket
    axes: np.ndarray  # buckets x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, of length one
    votes: np.ndarray  # their labels
    prior: float

    def weigh(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Counts by rarity, of length one."""
        w = counts * self.rarity[keys]
        return w / max(np.sqrt((w**2).sum()), 1e-12)

    def project(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(bags), self.axes.shape[1]), np.float32)
        for i, (keys, counts) in enumerate(bags):
            if len(keys):
                out[i] = self.weigh(keys, counts) @ self.axes[keys]
        size = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return out / np.where(size > 0, size, 1)

    def score(self, bags: list[tuple[np.ndarray, np.ndarray]], block: int = 256) -> np.ndarray:
        """The share of label 1 among the nearest labelled rows, by the square of their similarity.

        Rows as similar as the last of the nearest vote too, so ties don't matter. The prior if none is similar.
        """
        out = np.full(len(bags), self.prior)
        k = min(self.settings.neighbours, len(self.votes))
        if not k:
            return out
        for at in range(0, len(bags), block):
            near = self.project(bags[at : at + block]) @ self.vectors.T
            least = np.maximum(np.partition(near, -k, axis=1)[:, -k, None], 0)
            weight = np.where(near >= least, np.maximum(near, 0), 0).astype(np.float64) ** 2
            total = weight.sum(axis=1)
            some = total > 0
            out[at : at + block][some] = (weight @ self.votes)[some] / total[some]
        return np.clip(out, 0, 1)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, settings: Settings) -> Model:
    """The latent space by a randomised decomposition with two power steps; ties don't matter to it."""
    n, rows = settings.buckets, len(bags)
    seen = np.zeros(n)
    for keys, _ in bags:
        seen[keys] += 1
    rarity = np.log((1 + rows) / (1 + seen)).astype(np.float32) + 0.1
    prior = float(labels.mean()) if rows else 0.5
    model = Model(settings, rarity, np.zeros((n, 1), np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float64), prior)
    if not rows:
        return model
    a = np.zeros((rows, n), np.float32)
    for i, (keys, counts) in enumerate(bags):
        if len(keys):
            a[i, keys] = model.weigh(keys, counts)
    k = min(settings.dimensions, rows, n)
    y = a @ np.random.default_rng(settings.seed).standard_normal((n, k + 8), np.float32)
    for _ in range(2):
        y = a @ (a.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    model.axes = np.ascontiguousarray(np.linalg.svd(q.T @ a, full_matrices=False)[2][:k].T.astype(np.float32))
    model.vectors = model.project(bags)
    return model


def held_out(doc_id):
    """Rows that are never learnt from: crc32 of the id as text, modulo 5, is 0. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label_col: str = "quality") -> Model:
    """Fits on at most settings.sample_rows labelled rows of docs, those with the smallest hash of their id.

    Rows whose held_out() is true, labels other than 0 and 1, and labels without a document aren't learnt
    from. An id with both labels counts as 0; of an id's different texts that with the smallest hash
    counts. Without any labelled row the score of every text is 0.5.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").alias("__id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    known = docs.select("doc_id").join(usable, F.col("doc_id") == F.col("__id")).select("__id", "label").distinct()
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(settings.sample_rows)
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("mark"), text.alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))

    def featured(batches):
        words = _Words(settings.buckets)
        for batch in batches:
            got = [bag(t.as_py(), words) for t in batch.column(1)]
            cols = [batch.column(0), batch.column(3), batch.column(2), pa.array([k.tobytes() for k, _ in got], pa.binary()), pa.array([w.tobytes() for _, w in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "mark", "label", "keys", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sparse = rows.select("doc_id", "text", "label", "mark").mapInArrow(featured, f"doc_id {kind}, mark string, label int, keys binary, counts binary")
    one = sparse.groupBy("doc_id").agg(F.min_by(F.struct("label", "keys", "counts"), "mark").alias("own"))
    found = one.select("doc_id", "own.*").toArrow().sort_by("doc_id")
    bags = [(np.frombuffer(k.as_py(), np.int32), np.frombuffer(w.as_py(), np.float32)) for k, w in zip(found["keys"], found["counts"])]
    return fit(bags, np.array(found["label"].to_pylist(), np.int32), settings)


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs, from its whole text alone.

    Edge cases: null, empty and blank texts score the share of label 1 among the labelled rows; null ids
    stay null and aren't held out; repeated rows repeat; very long texts are bags of all their words; an
    empty table gives no rows. Ties among the nearest: see Model.score(). Other columns aren't looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        words = _Words(model_settings.buckets)
        for batch in batches:
            scores = shared.value.score([bag(t.as_py(), words) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    model_settings = model.settings
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= model_settings.threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model predicts as 1, all columns kept; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    settings, at = model.settings, docs.columns.index("text")

    def run(batches):
        words = _Words(settings.buckets)
        for batch in batches:
            scores = shared.value.score([bag(t.as_py(), words) for t in batch.column(at)])
            yield batch.filter(pa.array(scores >= settings.threshold))

    return docs.mapInArrow(run, docs.schema)
