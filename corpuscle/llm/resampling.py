"""Importance resampling towards a target's distribution, over a sparse document-by-bucket count matrix kept as CSR blocks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import LETTERS_AND_DIGITS, slices, stage, utf8, word_runs

BUCKETS, RUNS = 10_000, 2
#: Of the documents with so many words so many percent are drawn.
MIN_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of text whose counts make a block, but for a longer text alone.
SLICE = 2 << 20

_BLOCK = "doc_id array<long>, n_features array<long>, n_words array<long>, row_start array<int>, buckets binary, counts binary, width int"


def _index_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def feature_buckets(words: list[bytes], before: int, runs: int, buckets: int) -> np.ndarray:
    """The bucket of each run of 1 to runs words that ends at words[before] or later: its bytes' crc32, continued word by word, modulo buckets."""
    found = list(map(crc32, words))
    out = found[before:]
    for k in range(1, runs):
        found = list(map(crc32, words[k:], map(crc32, repeat(b" "), found)))
        out += found[max(0, before - k) :]
    return np.array(out, np.uint32) % np.uint32(buckets)


def _row(data: bytes, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(buckets that a text's features fall to, ascending; their counts; number of features; number of words)."""
    parts, kept, n_words, n_features = [], [], 0, 0
    for words in word_runs(data, LETTERS_AND_DIGITS):
        found = feature_buckets(kept + words, len(kept), runs, buckets)
        kept = (kept + words)[-(runs - 1) :] if runs > 1 else []
        n_words += len(words)
        n_features += len(found)
        parts.append(np.unique(found, return_counts=True))
    if len(parts) == 1:
        return (*parts[0], n_features, n_words)
    sums = np.zeros(buckets, np.int64)
    for at, counts in parts:
        sums[at] += counts
    some = np.flatnonzero(sums)
    return some, sums[some], n_features, n_words


def _to_blocks(runs: int, buckets: int):
    kind = _index_type(buckets)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            rows = [_row(data, runs, buckets) for data in utf8(batch.column("text"))]
            counts = np.concatenate([r[1] for r in rows])
            width = next(w for w in (1, 2, 4, 8) if not len(counts) or counts.max() < 1 << (8 * w - (w == 8)))
            starts = np.cumsum([0] + [len(r[0]) for r in rows])
            whole = lambda x, t: pa.array([x], pa.list_(t))
            columns = [
                whole(batch.column("doc_id").to_pylist(), pa.int64()), whole([r[2] for r in rows], pa.int64()), whole([r[3] for r in rows], pa.int64()), whole(starts, pa.int32()),
                pa.array([np.concatenate([r[0] for r in rows]).astype(kind).tobytes()], pa.binary()), pa.array([counts.astype(f"<u{width}").tobytes()], pa.binary()), pa.array([width], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "n_words", "row_start", "buckets", "counts", "width"])

    return run


def count_matrix(docs: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text) -> blocks of the document-by-bucket count matrix in compressed sparse rows, written to a stage table.

    A block holds up to 1,024 documents: row_start (one more than documents), and for all rows together the buckets,
    ascending in a row, and their counts, unsigned little-endian numbers (two bytes a bucket where buckets allow it,
    width bytes a count). A row has at most as many entries as there are buckets, however long its text. Null or empty
    texts have rows without entries.
    """
    return stage(docs.select("doc_id", "text").mapInArrow(_to_blocks(runs, buckets), _BLOCK), "count_matrix")


def _entries(block: dict, kind: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(block["buckets"], kind), np.frombuffer(block["counts"], f"<u{block['width']}").astype(np.int64)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The sum of each of the matrix's columns: added up in the tasks, at most a row for each bucket and task shuffled, one number a bucket collected."""
    kind = _index_type(buckets)

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                at, counts = _entries(block, kind)
                np.add.at(sums, at, counts)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["bucket", "n"])

    out = [0] * buckets
    found = matrix.select("buckets", "counts", "width").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in found.collect():  # at most buckets rows
        out[bucket] = n
    return out


def bucket_gains(own: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln of (target's share / own share)) of each bucket, with one added to each count."""
    n, m, k = float(sum(own)), float(sum(target)), len(own)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (n + k) / ((s + 1.0) * (m + k)))) for s, t in zip(own, target)], np.int64)


def _noise(seed: int, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def document_weights(matrix: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score): the product of the matrix with the gains, over each row's number of features, floored.

    score adds Gumbel noise drawn by sha256 of (seed, doc_id), so that the highest scores are a draw without
    replacement in proportion to exp(weight / 1000). Sums are exact. The gains, one number a bucket, go to every task.
    """
    kind = _index_type(len(gains))

    def run(batches):
        for batch in batches:
            for block in batch.to_pylist():
                at, counts = _entries(block, kind)
                sums = np.concatenate([[0], np.cumsum(gains[at] * counts)])[block["row_start"]]
                n = np.array(block["n_features"], np.int64)
                weight = np.where(n > 0, np.diff(sums) // np.maximum(n, 1), 0)
                noise = np.array([_noise(seed, i) for i in block["doc_id"]], np.int64)
                columns = [pa.array(block["doc_id"], pa.int64()), pa.array(n), pa.array(block["n_words"], pa.int64()), pa.array(weight), pa.array(weight + noise)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "n_words", "weight", "score"])

    return matrix.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, runs: int = RUNS, seed: int = SEED
) -> DataFrame:
    """docs (doc_id, text) and target (text) -> (doc_id, n_features, weight, score, rank), a row for each document.

    Features are all runs of 1 to runs consecutive words, hashed to buckets. Of the documents with at least min_words
    words, percent in a hundred, rounded down, are drawn by their scores; rank counts the drawn from 1 by score, highest
    first, then doc_id; the others' is null. A null text has no words, and weight 0; a null doc_id draws noise as ''
    would. Rows that repeat are drawn each, in either order. Empty docs give no rows; an empty target has equal shares
    of all buckets. Other columns are not read.
    """
    matrix = count_matrix(docs, runs, buckets)
    goal = column_sums(count_matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), runs, buckets), buckets)
    scored = stage(document_weights(matrix, bucket_gains(column_sums(matrix, buckets), goal), seed), "weights")
    may = F.col("n_words") >= min_words
    drawn = percent * scored.where(may).count() // 100
    ranked = numbered(scored.where(may), F.desc("score"), F.asc("doc_id"), name="_place")
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1).alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(scored.where(~may).select(*columns, F.lit(None).cast("long").alias("rank")))
