"""Exact deduplication: composable polynomial fingerprints, then a chunkwise comparison of equal ones.

A text is a number in base BASE modulo two primes. The fingerprint of x + y is f(x) * BASE**len(y) + f(y), so
chunks hash on their own and combine by length-shifted arithmetic, in any grouping and on any machine.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, release, slices, stage, utf8, without_rows

#: Two primes below 2**31 and the base of the polynomials.
PRIMES = (2147483647, 2147483629)
BASE = 1000003
#: Bytes hashed or compared at a time.
CHUNK = 1 << 16
#: Texts of more bytes are hashed as slices on many machines.
HUGE = 1 << 22

_powers: dict[int, np.ndarray] = {}


def _power_table(prime: int) -> np.ndarray:
    """BASE**(CHUNK-1) ... BASE**0 modulo prime, by doubling."""
    if prime not in _powers:
        rising = np.ones(1, dtype=np.int64)
        while len(rising) < CHUNK:
            rising = np.concatenate([rising, rising * pow(BASE, len(rising), prime) % prime])
        _powers[prime] = rising[:CHUNK][::-1].copy()
    return _powers[prime]


def combine(left: tuple[int, int], right: tuple[int, int], prime: int) -> tuple[int, int]:
    """(hash, length) of the concatenation of two texts from their (hash, length)."""
    return (left[0] * pow(BASE, right[1], prime) + right[0]) % prime, left[1] + right[1]


def polynomial(data: bytes, prime: int) -> tuple[int, int]:
    """(hash, length) of data: chunk hashes, combined."""
    table, out = _power_table(prime), (0, 0)
    for at in range(0, len(data), CHUNK):
        piece = np.frombuffer(data, dtype=np.uint8, count=min(CHUNK, len(data) - at), offset=at).astype(np.int64)
        out = combine(out, (int(np.dot(piece, table[-len(piece) :]) % prime), len(piece)), prime)
    return out


def _hash_texts(primes):
    def run(batches):
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            sums = [[polynomial(x, p)[0] for x in texts] for p in primes]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array(sums[0], pa.int64()),
                    pa.array(sums[1], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                ],
                ["doc_id", "n_bytes", "f1", "f2", "text_sha256"],
            )

    return run


def _hash_slices(primes):
    def run(batches):
        for batch in slices(batches):
            pieces = [x or b"" for x in batch.column("piece").to_pylist()]
            sums = [[polynomial(x, p)[0] for x in pieces] for p in primes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_sha256"), batch.column("no"), pa.array(map(len, pieces), pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64())],
                ["text_sha256", "no", "n", "f1", "f2"],
            )

    return run


def _combine_slices(primes):
    def run(batches):
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                sums = [(0, 0), (0, 0)]
                for part in sorted(parts, key=lambda x: x["no"]):
                    sums = [combine(s, (part[f], part["n"]), p) for s, f, p in zip(sums, ("f1", "f2"), primes)]
                out.append((sums[0][1], sums[0][0], sums[1][0]))
            n, f1, f2 = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_sha256"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())],
                ["text_sha256", "n_bytes", "f1", "f2"],
            )

    return run


def _explode_pieces(df: DataFrame, size: int, *keep: str) -> DataFrame:
    """A row for each slice of size bytes of column bytes; an empty text has one empty slice."""
    last = F.greatest(F.ceil(F.octet_length("bytes") / F.lit(size)), F.lit(1)) - 1
    sliced = df.select(*keep, "bytes", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("no"))
    return sliced.select(*keep, "no", F.expr(f"substring(bytes, no * {size} + 1, {size})").alias("piece"))


def fingerprints(docs: DataFrame, primes: tuple[int, int] = PRIMES, huge: int = HUGE) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_bytes, f1, f2, text_sha256), a row for each row of docs.

    Null text counts as empty. Texts of more than huge bytes are cut into slices that hash in parallel.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    small = base.where(F.octet_length("text") <= huge).mapInArrow(
        _hash_texts(primes), "doc_id long, n_bytes long, f1 long, f2 long, text_sha256 string"
    )
    large = base.where(F.octet_length("text") > huge).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.encode("text", "UTF-8").alias("bytes"))
    # equal texts have equal slices, so a slice is told by its text's digest and its number: the same in any run of a task
    cut = _explode_pieces(large, max(1, huge // 16), "doc_id", "text_sha256").repartition("doc_id", "text_sha256", "no")
    hashed = cut.select("text_sha256", "no", "piece").mapInArrow(_hash_slices(primes), "text_sha256 string, no int, n long, f1 long, f2 long")
    whole = (
        hashed.distinct()
        .groupBy("text_sha256")
        .agg(F.collect_list(F.struct("no", "n", "f1", "f2")).alias("parts"))
        .mapInArrow(_combine_slices(primes), "text_sha256 string, n_bytes long, f1 long, f2 long")
    )
    return small.unionByName(large.select("doc_id", "text_sha256").join(whole, "text_sha256"))


_KEY = ["n_bytes", "f1", "f2", "cls"]


def _differing(docs: DataFrame, prints: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of groups whose text differs from that of the row that would stay: chunk against chunk."""
    members = stage(prints.join(groups.select(*_KEY, "rep"), _KEY).select("doc_id", "text_sha256", *_KEY, "rep"), "members")
    near, maybe = maybe_in(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", members, "doc_id", members.count())
    told = members.withColumnRenamed("doc_id", "member_id").distinct()
    texts = (
        near.where(maybe)
        .join(told, F.col("doc_id").eqNullSafe(F.col("member_id")) & (F.sha2("text", 256) == F.col("text_sha256")))
        .select("doc_id", "text_sha256", *_KEY, "rep", F.encode("text", "UTF-8").alias("bytes"))
    )
    texts = stage(texts, "texts")
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_sha256") == F.col("rep.text_sha256"))
    theirs = stage(_explode_pieces(texts.where(is_rep), CHUNK, *_KEY).dropDuplicates([*_KEY, "no"]).withColumnRenamed("piece", "other"), "reps")
    ours = _explode_pieces(texts.where(~is_rep), CHUNK, "doc_id", "text_sha256", *_KEY)
    differ = ours.join(theirs, [*_KEY, "no"], "left").where(~F.col("piece").eqNullSafe(F.col("other")))
    out = stage(differ.select("doc_id", "text_sha256", *_KEY).distinct(), "differing")
    for old in (members, texts, theirs):
        release(old)
    return out


def exact_duplicates(docs: DataFrame, primes: tuple[int, int] = PRIMES, huge: int = HUGE) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs.

    Texts are equal when their bytes are; null counts as empty. keep_id is the largest doc_id of the equal texts
    (nulls last; null if all are). Rows that repeat a doc_id and its text are counted each and kept or dropped
    together. An empty table gives an empty result; other columns are ignored.
    Where fingerprints collide, the rows that differ from the staying row's text form a new class and are
    compared anew, until none differs.
    """
    prints = stage(fingerprints(docs, primes, huge).withColumn("cls", F.lit(0)), "fingerprints")
    level = 0
    while True:
        groups = stage(
            prints.groupBy(*_KEY)
            .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "text_sha256")).alias("rep"))
            .where("group_size > 1"),
            "groups",
        )
        differing = _differing(docs, prints, groups.where(F.col("cls") == level))
        if differing.isEmpty():
            break
        moved = differing.select(F.col("doc_id").alias("moved_id"), "text_sha256", *_KEY).withColumn("up", F.lit(1))
        on = F.col("p.doc_id").eqNullSafe(F.col("m.moved_id"))
        for name in ("text_sha256", *_KEY):
            on &= F.col(f"p.{name}") == F.col(f"m.{name}")
        prints = stage(
            prints.alias("p").join(moved.alias("m"), on, "left").select("p.doc_id", "p.n_bytes", "p.f1", "p.f2", "p.text_sha256", (F.col("p.cls") + F.coalesce("m.up", F.lit(0))).alias("cls")),
            "fingerprints",
        )
        level += 1
    found = prints.join(groups.select(*_KEY, "group_size", F.col("rep.doc_id").alias("rep_id")), _KEY, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("rep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, that of the largest doc_id (a null one if all are); all columns stay.

    Of rows that repeat that id too, the one of the least common.row_order stays.
    """
    told = exact_duplicates(docs).where("group_size > 1").groupBy("doc_id", "text_sha256", "kept").agg(F.count(F.lit(1)).alias("rows"))
    return without_rows(docs, told.where("not kept or rows > 1").select("doc_id", "text_sha256", F.col("kept").alias("one")))
