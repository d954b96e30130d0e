"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, release, slices, stage, utf8

#: Features are hashed to 2**BITS weights, which bounds what is sent to the executors.
BITS = 20
#: Labelled ids that are learned from at most: those of the smallest hashes, each from one text.
TRAIN_ROWS = 30_000
#: Parts that the rows to learn from are dealt to by hash; the driver holds one at a time.
PARTS = 16
EPOCHS, ALPHA, BETA, L1, L2 = 3, 2.0, 1.0, 6.0, 0.1
THRESHOLD = 0.3
CACHED = 150_000
# Odd multipliers that mix word hashes into features.
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: ASCII letters in lower case, digits as they are; other ASCII becomes a blank. Bytes of other scripts stay.
_WORDS = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32) for c in range(256))


class _WordNumbers(dict):
    """Numbers words as they are met; hashes holds the hash of each."""

    def __init__(self) -> None:
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.hashes = np.zeros(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[n] = xxhash.xxh64_intdigest(word)
        self[word] = n
        return n


_numbers = _WordNumbers()


def _forget() -> None:
    """At the end of a task: the worker may run other stages next."""
    _numbers.restart()
    give_back()


def features(data: bytes, weighted: np.ndarray | None = None) -> np.ndarray:
    """Distinct feature numbers of a text: words, pairs of neighbours, and skip-grams, pairs with one word between.

    weighted: only those with True there are wanted.
    """
    words = data.translate(_WORDS).split()
    if len(_numbers) > CACHED:
        _numbers.restart()
    at = np.fromiter(map(_numbers.__getitem__, words), np.int64, len(words))
    h = _numbers.hashes[at]
    shift = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        every = np.concatenate([h * _MIX[0], (h[:-1] * _MIX[1] + h[1:]) * _MIX[2], (h[:-2] * _MIX[3] + h[2:]) * _MIX[4]]) >> shift
    every = every.astype(np.int64)
    return np.unique(every if weighted is None else every[weighted[every]])


class Ftrl:
    """FTRL-proximal with per-coordinate rates; coordinate 2**BITS is the bias, which has no L1 term."""

    def __init__(self, prior: float) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)
        self.l1 = np.full((1 << BITS) + 1, L1)
        self.l1[-1] = 0.0
        self.prior = math.log(prior / (1 - prior))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1[at], 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum() + self.prior)))) - label
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - rate * w
        self.n[at] += g * g


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, their weights, bias) from docs (doc_id, text) and labels (doc_id, toxic).

    Labels of null, of held-out ids or without a document teach nothing; of several for an id the largest counts, of
    several texts of an id the least.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # bounded by train_rows
    rows = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in picked.collect()], "doc_id long, toxic int"))

    def to_features(batches):
        for batch in slices(batches):
            found = [features(x).astype("<u4").tobytes() for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "features"])
        _forget()

    texts = docs.select("doc_id", "text").join(rows, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = texts.mapInArrow(to_features, "doc_id long, toxic int, features binary")
    found = found.withColumn("hash", F.xxhash64("doc_id")).withColumn("part", F.pmod(F.col("hash"), F.lit(PARTS)).cast("int"))
    seen = stage(found, "features", by="part")
    total, ones = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
    model = Ftrl((ones + 0.1) / (total + 1))
    if ones:
        for _ in range(EPOCHS):
            for part in range(PARTS):  # in the order of the hashes, however the tables are dealt
                told = seen.where(F.col("part") == part).select("hash", "doc_id", "toxic", "features").toArrow()
                told = told.sort_by([("hash", "ascending"), ("doc_id", "ascending")])
                for toxic, data in zip(told.column("toxic").to_pylist(), told.column("features")):
                    model.learn(np.frombuffer(data.as_buffer(), "<u4").astype(np.int64), int(toxic > 0))
    release(seen)
    w = model.weights(np.arange((1 << BITS) + 1))
    at = np.flatnonzero(w[:-1])
    return at, w[at].astype(np.float32), float(w[-1] + model.prior)


def scorer(model: tuple[np.ndarray, np.ndarray, float]):
    at, values, bias = model

    def start():
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = values
        used = dense != 0

        def score(data: bytes) -> float:
            x = float(dense[features(data, used)].sum(dtype=np.float64)) + bias
            return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))

        return score

    return start


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, held_out, score, predicted), a row for each row of docs.

    Only the text is scored; null counts as empty and, like any text without a known feature, gets the bias.
    Without any toxic label to learn from, all get the smoothed share of toxic labels, at most 0.1.
    """
    start = scorer(train(docs, labels, train_rows))

    def run(batches):
        score = start()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(score, utf8(batch.column("text"))), pa.float64())], ["doc_id", "score"])
        _forget()

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold; all columns stay, nothing is shuffled."""
    start = scorer(train(docs, labels, train_rows))

    def run(batches):
        score = start()
        for batch in slices(batches):
            yield batch.filter(pa.array([score(x) < threshold for x in utf8(batch.column("text"))], pa.bool_()))
        _forget()

    return docs.mapInArrow(run, docs.schema)
