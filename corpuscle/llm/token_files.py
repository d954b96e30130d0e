"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, slices
from .tokens import SLICE, encoder

END_ID = 2
#: Stretches whose ids a worker keeps: more than elsewhere, as nothing else is held.
CACHED = 800_000
#: Tables of the parts' totals of up to so many rows go to every task; larger ones are joined by a shuffle.
LOCAL_PARTS = 100_000
#: Option names and values of ORC's writer.
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(64 << 20),
}


def _encode(path: str | None, end_id: int):
    def run(batches):
        encode = encoder(path, CACHED).ended
        before = 0  # ids of the documents before, in this partition
        for batch in slices(batches, 2 * SLICE):
            flat, sizes = encode(batch.column("text"), end_id)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int32)))
            columns = [batch.column("doc_id"), pa.array(before + offsets[:-1]), pa.array(sizes), ids]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part_start", "n_tokens", "ids"])
            before += int(offsets[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, files: int | None = None) -> None:
    """Writes docs (doc_id, text) as ORC files in ascending order of doc_id, null ids first, then of text.

    Texts are dealt out by ranges of ids before they are encoded, so that ids are never shuffled and each task
    writes sorted files of its own: part is its number, part_start counts the ids of the documents before in the part.
    """
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc("doc_id"), F.asc(F.xxhash64("text"))]
    dealt = docs.select("doc_id", "text").repartitionByRange(files, *order).sortWithinPartitions(*order, "text")
    encoded = dealt.mapInArrow(_encode(tokenizer, end_id), "doc_id long, part_start long, n_tokens long, ids array<int>")
    encoded.withColumn("part", F.spark_partition_id()).write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files at path; start counts the ids of all documents before.

    only: a predicate on doc_id; stripes and row groups that cannot match are skipped by statistics and Bloom
    filters. The totals of the parts, a row for each task that wrote, are read from narrow columns and joined back.
    """
    schema = "doc_id long, part_start long, n_tokens long, ids array<int>, part int"
    rows = spark.read.schema(schema).orc(path)
    sizes = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n")).collect()  # a row for each task that wrote
    bases, total = [], 0
    for row in sorted(sizes, key=lambda r: r.part):
        bases.append((row.part, total))
        total += row.n
    base = spark.createDataFrame(bases, "part int, _base long")
    rows = rows.where(only) if only is not None else rows
    joined = rows.join(F.broadcast(base) if len(bases) <= LOCAL_PARTS else base, "part", "left")
    return joined.select("doc_id", (F.col("_base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _digest(batches):
    for batch in slices(batches):
        ids = batch.column("ids")
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        kept = [batch.column(x) for x in ("doc_id", "start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    """read_token_files' rows -> (doc_id, start, n_tokens, ids_crc32 of the ids as little-endian unsigned 32-bit numbers)."""
    return tokens.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs as token files into the shared folder and returns digest() of what reading them back gives."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens.orc")
    write_token_files(docs, path, tokenizer)
    return digest(read_token_files(spark, path))
