"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, pairs of adjacent words and pairs with one word between,
hashed to 2**BITS places.  Words are lower-cased and stripped of ASCII punctuation.  FTRL-proximal
keeps for each place a sum of gradients and of their squares: frequent features get small steps,
rare ones large steps, and the L1 threshold leaves few weights that are not 0.  Those are broadcast.

The fit takes a bounded sample: the TRAIN_ROWS labelled ids (training part) that come first by a
hash of the id, each with one text: of several rows with one id the least.  Everything else covers all documents.

Defined results: a null or empty text has no features and scores as the bias says; without any
labelled row all scores are 0.5; rows repeated with one id are scored alike; of several labels of
one document the greatest counts; extra columns are ignored by the score and kept by the filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, id_text, map_batches, mixed, per_batch, raw_texts, table

BITS = 22
TRAIN_ROWS = 12000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.1
THRESHOLD = 0.3
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _plain(word: bytes) -> int:
    word = word.strip(PUNCTUATION)
    word = word.lower() if word.isascii() else word.decode("utf-8").lower().encode("utf-8")
    return xxhash.xxh3_64_intdigest(word)


_PLAIN = Words(_plain)


def features(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct places of the text's features."""
    words = (text or b"").split()
    h = np.fromiter(map(_PLAIN.__getitem__, words), np.uint64, len(words))
    pair = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    skip = mixed(h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] + np.uint64(1))
    return np.unique(np.concatenate([h, pair, skip]) >> np.uint64(64 - bits)).astype(np.int32)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader; the last place is the bias."""

    def __init__(self, bits: int = BITS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros((1 << bits) + 1, np.float32), np.zeros((1 << bits) + 1, np.float32)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at].astype(np.float64), self.n[at].astype(np.float64)
        kept = np.abs(z) - self.l1
        return np.where(kept > 0, -np.sign(z) * kept / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, -1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        before = self.n[at].astype(np.float64)
        after = before + g * g
        self.n[at] = after
        self.z[at] += g - (np.sqrt(after) - np.sqrt(before)) / self.alpha * w

    def kept(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Places and weights that are not 0, and the bias."""
        at = np.flatnonzero((self.z[:-1] > self.l1) | (self.z[:-1] < -self.l1))
        return at, self.weights(at), float(self.weights(np.array([-1]))[0])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights and bias.  docs (doc_id, text); labels (doc_id, y) of the training part."""
    chosen = labels.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def make(batch: pa.RecordBatch):
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "at": [features(t, bits) for t in raw_texts(batch.column("text"))]}

    # The sample has at most ``rows`` ids and as many texts, whatever the input.
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    coded = per_batch(sample, make, "doc_id long, y int, at array<int>")

    def train(batches):
        model, kept = Ftrl(bits), []
        for batch in batches:
            flat, ends = batch.column("at").flatten().to_numpy(), batch.column("at").offsets.to_numpy()
            ends = ends - ends[0] if len(ends) else ends
            kept += [(i, y, flat[a:b]) for i, y, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), ends[:-1], ends[1:])]
        kept.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0]).encode()), r[0], len(r[2]), r[2].tobytes()))
        for _ in range(EPOCHS):
            for _, y, at in kept:
                model.learn(at, y)
        at, w, bias = model.kept()
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(at, -1), pa.int32()), "w": pa.array(np.append(w, bias), pa.float64())})

    found = map_batches(coded.repartition(1), train, "at int, w double")
    got = found.toPandas()  # the weights that are not 0
    bias = got.loc[got["at"] < 0, "w"]
    got = got[got["at"] >= 0]
    return got["at"].to_numpy(), got["w"].to_numpy(), float(bias.iloc[0]) if len(bias) else 0.0


class Scorer:
    def __init__(self, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS):
        self.bits, self.bias = bits, model[2]
        self.dense = np.zeros(1 << bits, np.float32)
        self.dense[model[0]] = model[1]

    def __call__(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.dense[features(text, self.bits)].sum(dtype=np.float64) + self.bias, -35, 35))))


def scored(df: DataFrame, model, bits: int = BITS) -> DataFrame:
    """doc_id, score for every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    held: list[Scorer] = []

    def make(batch: pa.RecordBatch):
        if not held:
            held.append(Scorer(sent.value, bits))
        return {"doc_id": batch.column("doc_id"), "score": [held[0](t) for t in raw_texts(batch.column("text"))]}

    return per_batch(id_text(df), make, "doc_id long, score double")


def not_toxic(df: DataFrame, model, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """The rows of ``df`` that score below the threshold, with all their columns."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = Scorer(sent.value, bits)
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            keep = pa.array([score(t) < threshold for t in texts], pa.bool_())
            yield batch.filter(keep)

    return map_batches(df, run, df.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of the training part: crc32 of the id as text, mod 4, is not 2."""
    return labels.where(held_out().eqNullSafe(False) & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(id_text(docs), training_labels(table(spark, sf_dir, "labels")))
    got = scored(docs, model)
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
