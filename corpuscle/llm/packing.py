"""Sequence packing: shortest-pack-first over the histogram of lengths, patterns joined back by rank."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ragged, slices, stage
from .tokens import CACHED, SLICE, encoder

SEQUENCE, END_ID = 1024, 0
#: Pieces of a length that are ranked in one task, on average.
RANKED = 1_000


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """[(lengths in a pack, number of such packs)] that places every length of the histogram.

    Lengths go longest first, each time into the pattern with the shortest content; what a pattern's count
    exceeds stays behind as a pattern of its own. Pieces that fit no pattern open new ones, each with as many of
    them as it takes. The work depends on the histogram's width, not on its counts.
    """
    open_packs: list[tuple[int, int, list[int], int]] = []  # content, tie breaker, lengths, count
    full: list[tuple[list[int], int]] = []
    made = 0

    def put(lengths: list[int], count: int) -> None:
        nonlocal made
        made += 1
        if sum(lengths) == size:
            full.append((lengths, count))
        else:
            heapq.heappush(open_packs, (sum(lengths), made, lengths, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and open_packs and open_packs[0][0] + length <= size:
            _, _, lengths, count = heapq.heappop(open_packs)
            taken = min(left, count)
            if taken < count:
                put(lengths, count - taken)
            put(lengths + [length], taken)
            left -= taken
        together = size // length
        if left >= together:
            put([length] * together, left // together)
        if left % together:
            put([length] * (left % together), 1)
    return full + [(lengths, count) for _, _, lengths, count in open_packs]


def _slots(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, sequence of that rank, offset there, ranks a sequence) of the runs of ranks that share a pattern's place."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for lengths, count in patterns:
        at = 0
        for length, same in groupby(lengths):
            first, together = ranks.get(length, 0), len(list(same))
            out.setdefault(length, []).append((first, base, at, together))
            ranks[length] = first + count * together
            at += length * together
        base += count
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in out.items()}


def _cut(path: str | None, size: int, with_ids: bool, cached: int, width: int):
    def run(batches):
        encode = encoder(path, cached).ended
        for batch in slices(batches, SLICE):
            flat, tokens = encode(batch.column("text"), END_ID)
            n_pieces = -(-tokens // size)
            start = ragged(np.zeros(len(tokens), np.int64), n_pieces) * size
            doc = np.repeat(np.arange(len(tokens)), n_pieces)
            length = np.minimum(size, tokens[doc] - start)
            first = (np.cumsum(tokens) - tokens)[doc] + start
            data = memoryview(flat.astype("<u4")).cast("B")
            pieces = [data[4 * a : 4 * b] for a, b in zip(first.tolist(), (first + length).tolist())]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(map(zlib.crc32, pieces), pa.int64()), pa.array(tokens[doc])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                narrow = memoryview(flat.astype(f"<u{width}")).cast("B")
                columns.append(pa.array([bytes(narrow[width * a : width * b]) for a, b in zip(first.tolist(), (first + length).tolist())], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def cut_documents(docs: DataFrame, size: int = SEQUENCE, tokenizer: str | None = None, with_ids: bool = False, cached: int = CACHED, width: int = 4) -> DataFrame:
    """docs (doc_id, text) -> pieces (doc_id, start, length, ids_crc32, doc_tokens[, ids: little-endian unsigned numbers of width bytes]).

    Every document, of null or empty text too, ends with id 0; it is cut every size ids. ids_crc32 is that of four
    bytes an id; a width of 2 suits vocabularies of up to 65,536 ids.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, size, with_ids, cached, width), schema)


def place_pieces(pieces: DataFrame, size: int, patterns: Callable[[dict[int, int], int], list[tuple[list[int], int]]]) -> DataFrame:
    """pieces (doc_id, start, length, ids_crc32, ...; a stage table) with sequence_id and offset, as patterns(histogram of lengths, size) has them.

    Pieces of a length are ranked by (bucket, id, start, ids_crc32); the pattern that a rank falls to gives the
    sequence and the place in it. The histogram, at most size rows, is all that the driver sees.
    """
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most size rows
    slots = _slots(patterns({r.length: r.n for r in counted}, size))
    # lengths of many pieces are ranked in several buckets: at most size + pieces / RANKED of them in all
    shares = {r.length: r.n // RANKED + 1 for r in counted}
    of_length = F.split(F.lit(",".join(str(shares.get(k, 1)) for k in range(size + 1))), ",").cast("array<int>")
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), of_length[F.col("length").cast("int")]).cast("int")
    dealt = pieces.withColumn("bucket", bucket)
    before = (
        stage(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "bucket_sizes")
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("before")).cast("long").alias("rank"))

    names = list(pieces.columns)

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                first, base, at, together = slots[int(length)]
                mine = np.flatnonzero(lengths == length)
                run = np.searchsorted(first, ranks[mine], side="right") - 1
                number, nth = np.divmod(ranks[mine] - first[run], together[run])
                sequence[mine] = base[run] + number
                offset[mine] = at[run] + nth * length
            kept = [batch.column(x) for x in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = SEQUENCE, tokenizer: str | None = None, with_ids: bool = False, cached: int = CACHED, width: int = 4) -> DataFrame:
    """cut_documents' pieces with sequence_id and offset: offsets in a sequence are gapless from 0, its ids at most size.

    Rows that repeat are packed each. An empty table gives no rows. A worker keeps the ids of cached words.
    """
    return place_pieces(stage(cut_documents(docs, size, tokenizer, with_ids, cached, width), "pieces"), size, shortest_pack_first)


def sequences(packed: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """(sequence_id, ids array<long>, length): the packed pieces with their ids, joined in order of offset, padded with END_ID to size.

    length is the number of ids before the padding.
    """

    def run(batches):
        for batch in slices(batches):
            out, lengths = [], []
            for parts in batch.column("parts").to_pylist():
                data = b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["offset"]))
                width = len(parts[0]["ids"]) // parts[0]["length"]
                ids = np.full(size, END_ID, np.int64)
                ids[: len(data) // width] = np.frombuffer(data, f"<u{width}")
                out.append(ids)
                lengths.append(len(data) // width)
            columns = [batch.column("sequence_id"), pa.array(out, pa.list_(pa.int64())), pa.array(lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["sequence_id", "ids", "length"])

    grouped = packed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "length", "ids")).alias("parts"))  # at most size pieces
    return grouped.mapInArrow(run, "sequence_id long, ids array<long>, length long")
